"""Connected groups of links, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corepick.llm.common import cut


def connected_groups(links: DataFrame) -> DataFrame:
    """``v, root`` for every end of ``links(a, b)``: the least end that it is connected to.

    Large-star and small-star rounds in turn: each end points its larger neighbours, then its smaller ones, to the least of
    them, until nothing changes. Every step is a pre-aggregated minimum and a join that keeps one row per link; nothing
    gathers the neighbours of one end, and the number of links never grows. Nulls and self links drop out, repeated links
    count once, no links give no rows.
    """
    edges = links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges = cut(edges)
    while True:
        both = edges.select(F.col("lo").alias("v"), F.col("hi").alias("u")).union(edges.select(F.col("hi").alias("v"), F.col("lo").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("m").alias("lo"), F.col("u").alias("hi"))
        large = large.filter("lo <> hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(least.select(F.col("m").alias("lo"), "hi")).distinct()
        small = cut(small)
        # a star has no end that is both the lesser and the greater one, and one root for each greater end
        ends = small.select(F.col("lo").alias("v"), F.lit(0).alias("n")).union(small.select("hi", F.lit(1)))
        ends = ends.groupBy("v").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
        done = ends.filter("n > 1 OR n = 1 AND least = 0").isEmpty()
        edges = small
        if done:
            roots = edges.select("lo").distinct().select(F.col("lo").alias("v"), F.col("lo").alias("root"))
            return edges.select(F.col("hi").alias("v"), F.col("lo").alias("root")).union(roots)
