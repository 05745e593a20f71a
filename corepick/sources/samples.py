"""Sample tables: reading one split, plain labels, and tables kept under a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The table at ``path``, or one split of it; a missing table or an unknown split name is an error."""
    df = spark.read.parquet(path)
    if split is None:
        return df
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split!r}")
    return df.filter(F.col("split") == split)


def normalize_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels as ``bigint``; a one-element array gives its element."""
    column = F.col(label)
    if isinstance(df.schema[label].dataType, T.ArrayType):
        column = F.element_at(column, 1)
    return df.withColumn(label, column.cast("bigint"))


def load_or_compute(spark: SparkSession, base: str, key: dict[str, object], compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table kept under ``key`` (kind, dataset, split, source, size, ...), computed and written first if it is not there."""
    path = base.rstrip("/") + "".join(f"/{k}={v}" for k, v in key.items())
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    compute().write.mode("overwrite" if force else "errorifexists").parquet(path)
    return spark.read.parquet(path)
