"""Class statistics, classification metrics, and reports over results tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corepick.functions.vectors import l2_normalize


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """One row per class with its count, beside the least, largest, mean and population deviation of all counts."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("std_n"))
    return counts.crossJoin(F.broadcast(total)).withColumn("imbalance", F.col("max_n") / F.col("min_n"))


def class_centroids(samples: DataFrame) -> DataFrame:
    """``label, centroid``: means of raw vectors, place by place, so that no task gathers a class."""
    long = samples.select("label", F.posexplode("v").alias("p", "x")).groupBy("label", "p").agg(F.avg("x").alias("x"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda t: t["x"]).alias("centroid"))


def classification_metrics(predicted: DataFrame) -> DataFrame:
    """One row from ``(label, pred)``: accuracy, balanced accuracy over the classes present, best and worst class."""
    by_class = per_class_accuracy(predicted)
    return by_class.agg(
        (F.sum(F.col("class_accuracy") * F.col("class_count")) / F.sum("class_count")).alias("accuracy"),
        F.avg("class_accuracy").alias("balanced_accuracy"),
        F.max_by("class", F.struct("class_accuracy", -F.col("class"))).alias("best_class"),
        F.min_by("class", F.struct("class_accuracy", "class")).alias("worst_class"),
    )


def per_class_accuracy(predicted: DataFrame) -> DataFrame:
    hit = (F.col("label") == F.col("pred")).cast("double")
    return predicted.groupBy(F.col("label").cast("long").alias("class")).agg(F.avg(hit).alias("class_accuracy"), F.count("*").alias("class_count"))


def with_baselines(results: DataFrame) -> DataFrame:
    """Rows without embeddings (``none``) are repeated under every embedding of their dataset."""
    named = results.filter("embedding <> 'none'")
    each = named.select(F.col("dataset").alias("d_"), F.col("embedding").alias("e_")).distinct()
    copies = results.filter("embedding = 'none'").join(each, F.col("dataset") == F.col("d_")).withColumn("embedding", F.col("e_")).drop("d_", "e_")
    return named.unionByName(copies)


def summary_table(results: DataFrame, ratios: list[float], metric: str = "balanced_accuracy") -> DataFrame:
    """Mean, sample deviation and ``mean±std`` of a metric in percent, a column set per ratio."""
    stats = with_baselines(results).groupBy("dataset", "embedding", "method").pivot("ratio", ratios).agg(F.round(F.avg(metric) * 100, 6).alias("mean"), F.round(F.stddev_samp(metric) * 100, 6).alias("std"))
    out = ["dataset", "embedding", "method"]
    for r in ratios:
        tag = f"r{round(r * 10000):04d}bp"
        mean, std = F.col(f"`{r}_mean`"), F.col(f"`{r}_std`")
        out += [mean.alias(f"{tag}_mean"), std.alias(f"{tag}_std"), F.when(mean.isNotNull(), F.format_string("%.1f±%.1f", F.round(mean, 1), F.round(F.coalesce(std, F.lit(0.0)), 1))).alias(f"{tag}_text")]
    return stats.select(*out)


def trial_summary(results: DataFrame, metrics: tuple[str, ...] = ("accuracy", "balanced_accuracy", "seconds"), keys: tuple[str, ...] = ("dataset", "method", "ratio")) -> DataFrame:
    """Mean and population deviation over trials."""
    aggs = [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return results.groupBy(*keys).agg(*aggs)


def milestone_table(history: DataFrame, milestones: tuple[int, ...], keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Per key the mean over trials of the best balanced accuracy up to each step (0 if none)."""
    best = [F.coalesce(F.max(F.when(F.col("step") <= m, F.col("bal_acc"))), F.lit(0.0)).alias(f"m{m}") for m in milestones]
    return history.groupBy(*keys, "trial").agg(*best).groupBy(*keys).agg(*(F.avg(f"m{m}").alias(f"at_{m}") for m in milestones))


def best_checkpoint(history: DataFrame, keys: tuple[str, ...] = ("method", "trial")) -> DataFrame:
    """The first step of the highest balanced accuracy, and the accuracy there."""
    best = F.max(F.struct("bal_acc", (-F.col("step")).alias("minus"), "acc")).alias("b")
    return history.groupBy(*keys).agg(best).select(*keys, (-F.col("b.minus")).alias("best_step"), F.col("b.bal_acc").alias("best_bal_acc"), F.col("b.acc").alias("acc_at_best"))


def list_runs(results: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs: how many datasets, embeddings, methods and rows each has."""
    runs = results.groupBy("run_id").agg(F.count_distinct("dataset").alias("datasets"), F.count_distinct("embedding").alias("embeddings"), F.count_distinct("method").alias("methods"), F.count("*").alias("n_rows"))
    return runs.orderBy(F.desc("run_id")).limit(limit)


def analyze_run(results: DataFrame, ratios: list[float], run_id: str = "all") -> DataFrame:
    """:func:`summary_table` of one run or of all; an unknown run is an error."""
    some = results if run_id == "all" else results.filter(F.col("run_id") == run_id)
    if run_id != "all" and some.isEmpty():
        raise ValueError(f"no run {run_id!r}")
    return summary_table(some, ratios)


def compare_to_expected(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per (dataset, ratio, method): difference in points, its size, z, and whether it is within one deviation."""
    keys = ["dataset", "ratio", "method"]
    delta = F.col("balanced_accuracy") * 100 - F.col("mean")
    both = results.join(expected, keys)
    return both.select(*keys, delta.alias("delta"), F.abs(delta).alias("abs_delta"), (delta / F.nullif(F.col("std"), F.lit(0.0))).alias("z"), (F.abs(delta) <= F.col("std")).alias("within_std"))


def config_audit(results: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("dataset", "ratio", "method")) -> DataFrame:
    """``kind`` (duplicate, missing, unexpected) and the key of each configuration that is not there exactly once."""
    kind = lambda df, name: df.select(*keys, F.lit(name).alias("kind"))
    parts = [
        kind(results.groupBy(*keys).count().filter("count > 1"), "duplicate"),
        kind(expected.select(*keys).distinct().join(results, list(keys), "left_anti"), "missing"),
        kind(results.select(*keys).distinct().join(expected, list(keys), "left_anti"), "unexpected"),
    ]
    return reduce(DataFrame.unionByName, parts)


def coverage_score(kernel: DataFrame, selection: DataFrame, importance: DataFrame) -> DataFrame:
    """One row: the importance-weighted mean of how well the selection covers each row. ``kernel(src, dst, w)``"""
    best = kernel.join(selection.select(F.col("id").alias("dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.max("w").alias("c"))
    joined = importance.select("id", "importance").join(best, "id", "left")
    return joined.agg((F.sum(F.col("importance") * F.coalesce("c", F.lit(0.0))) / F.sum("importance")).alias("coverage"))


def selection_quality(samples: DataFrame, selection: DataFrame, importance: DataFrame) -> DataFrame:
    """Per class: mean and population deviation of the selected importance, cosine of the subset's mean to the class's."""
    picked = selection.select("id", "label")
    imp = picked.join(importance.select("id", "importance"), "id").groupBy("label").agg(F.avg("importance").alias("imp_mean"), F.stddev_pop("importance").alias("imp_std"))
    own = samples.join(picked.select("id"), "id", "left_semi")
    both = class_centroids(samples).join(class_centroids(own).withColumnRenamed("centroid", "sub"), "label")
    unit = lambda c: l2_normalize(F.col(c))
    cosine = F.aggregate(F.zip_with(unit("centroid"), unit("sub"), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return both.select("label", cosine.alias("mean_cosine")).join(imp, "label")


