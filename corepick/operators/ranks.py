"""Places of rows in the order of a column, within groups of any size: no task sorts a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.operators.runtime import cut

BROADCAST_RUNS = 100_000


def placed(df: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """``df`` with ``place_`` (from 0) within ``group`` in the order of ``keys`` (nulls first) and ``size_``, the rows of the group.

    Rows are dealt out in ranges of ``group`` and ``keys``; each range counts its rows of a group, and what lies in the ranges
    before is added. Keys should tell rows apart: equal ones meet in one range.
    """
    rows = df.repartitionByRange(*group, *keys).sortWithinPartitions(*group, *keys)
    rows = cut(rows.withColumn("mark_", F.monotonically_increasing_id())).withColumn("range_", F.shiftrightunsigned("mark_", 33))
    runs = rows.groupBy(*group, "range_").agg(F.count("*").alias("n_"), F.min("mark_").alias("first_"))
    own = Window.partitionBy(*group)  # of a row for each range
    shift = F.sum("n_").over(own.orderBy("range_")) - F.col("n_") - F.col("first_")
    runs = cut(runs.select(*(F.col(c).alias(f"{c}_g_") for c in group), F.col("range_").alias("r_"), shift.alias("shift_"), F.sum("n_").over(own).alias("size_")))
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    met = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_g_")) for c in group), F.col("range_") == F.col("r_"))
    return rows.join(runs, met).select(*df.columns, (F.col("mark_") + F.col("shift_")).alias("place_"), "size_")


def percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row ``p``: exact percentiles, between two values in proportion; nulls do not count, and without values they are null."""
    x = df.select(F.col(column).cast("double").alias("x_"), F.xxhash64(F.monotonically_increasing_id()).alias("t_")).filter("x_ IS NOT NULL")
    rows = placed(x, [], ["x_", "t_"])
    parts = []
    for share in shares:
        at = F.lit(share) * (F.col("size_") - 1)
        for side in (F.floor(at), F.ceil(at)):
            parts += [F.max(F.when(F.col("place_") == side, F.col("x_")))]
    values = [c.alias(f"v{i}_") for i, c in enumerate(parts)]
    found = rows.agg(F.max("size_").alias("n_"), *values)
    between = []
    for i, share in enumerate(shares):
        at, low, high = F.lit(share) * (F.col("n_") - 1), F.col(f"v{2 * i}_"), F.col(f"v{2 * i + 1}_")
        # equal neighbours are the percentile itself; their weighted sum may be off in the last digit, so that they would lie beyond it
        between.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return found.select(F.array(*between).alias("p"))
