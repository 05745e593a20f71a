"""Scores and budgets: normalisation, importance formulas, path keys, metric rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.operators.ranks import percentiles, placed

FLAT = 1e-8


def _scaled(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi - lo <= FLAT, F.lit(1.0)).otherwise((x - lo) / (hi - lo))


def min_max_normalize(df: DataFrame, column: str) -> DataFrame:
    """``column`` scaled to [0, 1] over the table, all 1 if its range is at most 1e-8. The range is one broadcast row."""
    span = df.agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"))
    return df.crossJoin(F.broadcast(span)).withColumn(column, _scaled(F.col(column), F.col("lo_"), F.col("hi_"))).drop("lo_", "hi_")


def min_max_normalize_by_class(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """The same within each label; ranges are pre-aggregated, so that a class may be of any size."""
    span = df.groupBy(F.col(label).alias("c_")).agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"))
    return df.join(span, df[label].eqNullSafe(F.col("c_"))).withColumn(column, _scaled(F.col(column), F.col("lo_"), F.col("hi_"))).drop("lo_", "hi_", "c_")


def is_uniform(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """One row ``is_uniform``: all values close to that of the least key."""
    first = df.agg(F.min_by(column, key).alias("x0_"))
    close = F.abs(F.col(column) - F.col("x0_")) <= 1e-8 + 1e-5 * F.abs("x0_")
    return df.crossJoin(F.broadcast(first)).agg(F.bool_and(close).alias("is_uniform"))


def budget_per_class(df: DataFrame, ratio: float, label: str = "label") -> DataFrame:
    """One row: ``budget`` (floored twice) and ``compare_budget`` (at least 1)."""
    one = df.agg(F.count("*").alias("n"), F.count_distinct(label).alias("c"))
    share = F.col("n") * F.lit(ratio)
    return one.select(F.floor(F.floor(share) / F.col("c")).alias("budget"), F.greatest(F.lit(1).cast("long"), F.floor(share / F.col("c"))).alias("compare_budget"))


def ratio_bp(ratio: Column) -> Column:
    return F.format_string("r%04dbp", F.round(ratio * 10000).cast("int"))


def rounded_metrics(df: DataFrame, rates: tuple[str, ...] = (), seconds: tuple[str, ...] = (), rates_of_learning: tuple[str, ...] = ()) -> DataFrame:
    digits = {**dict.fromkeys(rates, 6), **dict.fromkeys(seconds, 2), **dict.fromkeys(rates_of_learning, 8)}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def raw_importance(df: DataFrame, method: str) -> DataFrame:
    """``id, label, importance`` by one of the column formulas, from ``el2n`` or ``conf_var, conf_mean``."""
    keep = [c for c in ("id", "label") if c in df.columns]
    if method == "el2n_mid":
        middle = percentiles(df, "el2n", [0.5]).select(F.get("p", F.lit(0)).alias("m_"))
        return df.crossJoin(F.broadcast(middle)).select(*keep, (-F.abs(F.col("el2n") - F.col("m_"))).alias("importance"))
    formulas = {
        "uniform": F.lit(1.0),
        "el2n_easy": -F.col("el2n"),
        "el2n_hard": F.col("el2n"),
        "variance_low": F.col("conf_mean") - F.col("conf_var"),
        "variance_high": F.col("conf_var"),
    } if method != "uniform" else {"uniform": F.lit(1.0)}
    if method not in formulas:
        raise ValueError(f"unknown importance formula {method!r}")
    return df.select(*keep, formulas[method].alias("importance"))


def top_k_per_class(df: DataFrame, score: str, budget: int, descending: bool = True, label: str = "label", key: str = "id") -> DataFrame:
    """``id, label, rank``: the ``budget`` best of each class; ties go to the least id. Spark keeps ``budget`` rows a task and class."""
    order = F.desc(score) if descending else F.asc(score)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order, key))
    return df.withColumn("rank", rank).filter(F.col("rank") <= budget).select(F.col(key).alias("id"), F.col(label).alias("label"), "rank")


def mid_k_per_class(df: DataFrame, score: str, budget: int, label: str = "label", key: str = "id") -> DataFrame:
    """The ``budget`` rows from place ``(n - budget) // 2`` of each class in ascending order."""
    ranked = placed(df.select(key, label, score), [label], [score, key])
    start = F.greatest(F.lit(0), F.floor((F.col("size_") - budget) / 2))
    middle = ranked.filter((F.col("place_") >= start) & (F.col("place_") < start + budget))
    return middle.select(F.col(key).alias("id"), F.col(label).alias("label"), (F.col("place_") - start + 1).cast("int").alias("rank"))


def hash_order(seed: int, key: Column) -> Column:
    """Random order that does not depend on how rows are dealt out."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))
