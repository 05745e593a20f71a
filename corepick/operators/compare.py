"""Comparisons of selections, and samples in hash order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.functions.scores import hash_order
from corepick.operators.ranks import placed


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ``overlap_pct`` (of a) and ``jaccard``."""
    both = a.select("id", F.lit(1).alias("in_a")).distinct().join(b.select("id", F.lit(1).alias("in_b")).distinct(), "id", "full")
    common, size_a = F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()), F.count("in_a")
    return both.agg((common / F.nullif(size_a, F.lit(0)) * 100).alias("overlap_pct"), (common / F.nullif(F.count("*"), F.lit(0))).alias("jaccard"))


def overlap_matrix(selections: DataFrame) -> DataFrame:
    """``a, b, overlap_pct`` for every ordered pair of configurations of ``(config, id)``; a pair without common ids is 0.

    The ids of a configuration are bitmaps, 65,536 ids to a block; a task has the bitmaps of one block for all configurations and
    counts the bits that each two have in common.
    """
    s = selections.select("config", "id")
    word = F.shiftright("id", 6)
    words = s.filter("id IS NOT NULL").groupBy("config", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(id & 63 AS INT))")).alias("bits"))
    words = words.select("config", F.shiftright("word", 10).alias("block"), F.col("word").bitwiseAND(1023).cast("int").alias("word"), "bits")

    def common_bits(table):
        names = table["config"].combine_chunks().dictionary_encode()
        maps = np.zeros((len(names.dictionary), 1024), np.uint64)
        maps[names.indices.to_numpy(), table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        counts = np.stack([np.bitwise_count(maps & own).sum(1, dtype=np.int64) for own in maps])
        a, b = np.nonzero(counts)
        return pa.table({"a": names.dictionary.take(pa.array(a)), "b": names.dictionary.take(pa.array(b)), "c": pa.array(counts[a, b])})

    sizes = words.groupBy("config").agg(F.sum(F.bit_count("bits")).alias("n"))
    common = words.groupBy("block").applyInArrow(common_bits, "a string, b string, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    pairs = sizes.withColumnRenamed("config", "a").crossJoin(sizes.select(F.col("config").alias("b")))
    return pairs.join(common, ["a", "b"], "left").select("a", "b", (F.coalesce("c", F.lit(0)) / F.col("n") * 100).alias("overlap_pct"))


def unique_per_config(selections: DataFrame) -> DataFrame:
    s = selections.select("config", "id").distinct()
    alone = s.groupBy("id").agg(F.count("*").alias("n"), F.first("config").alias("config")).filter("n = 1").groupBy("config").agg(F.count("*").alias("n_unique"))
    sizes = s.groupBy("config").agg(F.count("*").alias("n"))
    return sizes.join(alone, "config", "left").select("config", F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique"), (F.coalesce("n_unique", F.lit(0)) / F.col("n")).alias("share"))


def selection_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id", F.lit(True).alias("in_a")).join(b.select("id", F.lit(True).alias("in_b")), "id", "full")
    return both.select("id", F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("shared").alias("side"))


def selection_class_counts(selection: DataFrame, pool: DataFrame) -> DataFrame:
    classes = pool.select("label").distinct()
    n = selection.groupBy("label").agg(F.count("*").alias("n"))
    counts = classes.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"))))


def stratified_subsample(df: DataFrame, n_target: int, seed: int = 42) -> DataFrame:
    """``n_target`` rows: floored class shares of at least 1; what is missing goes to the first classes one each, what is too
    much is taken from the last."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    quota = counts.crossJoin(F.broadcast(total)).withColumn("q", F.least("n", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * n_target / F.col("all")))))
    short = quota.agg((F.lit(n_target) - F.sum("q")).alias("short"))
    one = Window.orderBy("label")  # one row a class
    quota = quota.crossJoin(F.broadcast(short)).withColumn("place", F.row_number().over(one))
    more = F.when((F.col("short") > 0) & (F.col("place") <= F.col("short")), 1).when((F.col("short") < 0) & (F.col("classes") - F.col("place") < -F.col("short")), -1).otherwise(0)
    quota = quota.select(F.col("label").alias("c_"), F.least("n", F.col("q") + more).alias("q"))
    return _hash_sample(df, quota, seed)


def proportional_subsample(df: DataFrame, most: int, seed: int = 42) -> DataFrame:
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    quota = counts.crossJoin(F.broadcast(total)).select(F.col("label").alias("c_"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * most / F.col("all"))).alias("q"))
    return _hash_sample(df, quota, seed)


def _hash_sample(df: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    ranked = placed(df.select("id", "label", hash_order(seed, F.col("id")).alias("h_")), ["label"], ["h_", "id"])
    kept = ranked.join(quota, F.col("label") == F.col("c_")).filter(F.col("place_") < F.col("q"))
    return kept.select("id", "label", (F.col("place_") + 1).cast("int").alias("rank"))


def uniform_subsample(df: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """Up to ``most`` rows in hash order."""
    return df.select("id", "label", hash_order(seed, F.col("id")).alias("h_")).orderBy("h_", "id").limit(most).select("id", "label")
