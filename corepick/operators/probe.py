"""A linear probe and a plane projection, by ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corepick.operators.metrics import classification_metrics


def linear_probe(train: DataFrame, test: DataFrame) -> DataFrame:
    """Metrics on ``test(label, v)`` of a multinomial logistic regression with inverse penalty 1 (of the sum of losses)."""
    ready = lambda df: df.select(F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))
    rows = ready(train).cache()
    model = LogisticRegression(family="multinomial", regParam=1.0 / max(1, rows.count()), elasticNetParam=0.0, standardization=False, maxIter=1000).fit(rows)
    rows.unpersist()
    return classification_metrics(model.transform(ready(test)).select(F.col("label").cast("long"), F.col("prediction").cast("long").alias("pred")))


def project_2d(samples: DataFrame, selections: DataFrame) -> DataFrame:
    """``id, label, x, y, picked_by``: two principal components; the largest loading of each is made positive."""
    rows = samples.select("id", "label", array_to_vector("v").alias("raw"))
    rows = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="features", outputCol="p").fit(rows)
    loads = model.pc.toArray()
    sign = [1.0 if loads[abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    p = vector_to_array("p")
    by = selections.groupBy("id").agg(F.array_sort(F.collect_set("config")).alias("picked_by"))
    return model.transform(rows).select("id", "label", (p[0] * sign[0]).alias("x"), (p[1] * sign[1]).alias("y")).join(by, "id", "left")
