"""All registered queries of the coreset operators and the SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(spark, sf_dir)``; double columns, which are named for the SQL, are rounded to 6 digits on both sides."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            rounded = {c: F.round(c, 6) + F.lit(0.0) for c, t in df.dtypes if t == "double"}
            return df.withColumns(rounded) if rounded else df

        QUERIES[name] = run
        if sql is not None:
            rounds = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            SQL[name] = f"SELECT * REPLACE ({rounds}) FROM ({sql})" if rounds else sql
        return fn

    return add


def _load() -> None:
    from corepick.plans import analysis, selection, storage  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
