"""Logs of results: tables that widen as new columns come, histories, and selections by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_results(rows: DataFrame, path: str) -> None:
    """Append; columns that are new are null in the rows before."""
    rows.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def union_history(parts: list[DataFrame]) -> DataFrame:
    """Rows with differing columns; the header is the union in order of first sight."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_history(parts: list[DataFrame], path: str) -> None:
    union_history(parts).write.mode("overwrite").csv(path, header=True)


def selection_map(selections: DataFrame) -> DataFrame:
    """``config, ids`` with the ids in ascending order."""
    return selections.groupBy("config").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def write_selection_map(selections: DataFrame, path: str) -> None:
    selection_map(selections).write.mode("overwrite").json(path)
