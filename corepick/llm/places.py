"""Places of rows in an order, within groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.llm.common import cut, fits

BROADCAST_RUNS = 200_000


def same(a: list[Column], b: list[Column]) -> Column:
    """Equal column by column; a null equals a null."""
    return reduce(lambda x, y: x & y, (x.eqNullSafe(y) for x, y in zip(a, b)))


def in_order(df: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """``df`` dealt out in ranges of ``keys`` (nulls first), with a number ``mark`` that rises in their order.

    Equal rows are told apart by where they were read, so that no number of copies has to fit into one range. The result is
    checkpointed: ``mark`` stays what it is. Its upper bits are the range, the lower 33 the place there.
    """
    dealt = df.withColumn(mark, F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*keys, mark).sortWithinPartitions(*keys, mark)
    return cut(dealt.withColumn(mark, F.monotonically_increasing_id()))


def placed(df: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """``df`` with ``pos`` (from 0) within ``group`` in the order of ``keys`` and ``size``, the rows of the group.

    Each range counts its rows of a group; what lies in the ranges before is added. Names with a trailing underscore are taken.
    """
    rows = in_order(df, [*group, *keys], "mark_").withColumn("range_", F.shiftrightunsigned("mark_", 33))
    runs = rows.groupBy(*group, "range_").agg(F.count("*").alias("n_"), F.min("mark_").alias("first_"))
    own = Window.partitionBy(*group)
    runs = runs.select(
        *(F.col(c).alias(f"{c}_g_") for c in group),
        F.col("range_").alias("r_"),
        (F.sum("n_").over(own.orderBy("range_")) - F.col("n_") - F.col("first_")).alias("shift_"),
        F.sum("n_").over(own).alias("size"),
    )
    runs = cut(runs)
    runs = F.broadcast(runs) if fits(runs, BROADCAST_RUNS) else runs
    met = same([F.col(c) for c in [*group, "range_"]], [F.col(c) for c in [*(f"{c}_g_" for c in group), "r_"]])
    return rows.join(runs, met).select(*df.columns, (F.col("mark_") + F.col("shift_")).alias("pos"), "size")
