"""Scores from per-epoch predictions ``(id, epoch, label, logits, probs)``, as conditional aggregates by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.functions import vectors as v
from corepick.operators.ranks import percentiles


def epoch_metrics(predictions: DataFrame) -> DataFrame:
    """``id, epoch, label, l2, margin, correct, confidence``"""
    y = F.col("label")
    return predictions.select("id", "epoch", "label", v.l2_error(F.col("probs"), y).alias("l2"), v.margin(F.col("probs"), y).alias("margin"), v.correct(F.col("logits"), y).alias("correct"), v.confidence(F.col("probs"), y).alias("confidence"))


def in_window(start: int, length: int) -> Column:
    return F.col("epoch").between(start, start + length - 1)


def window_variance(metrics: DataFrame, start: int, length: int) -> DataFrame:
    """``id, variance`` of the errors over ``length`` epochs from ``start`` (from 1); null where the window is empty."""
    return metrics.groupBy("id").agg(F.var_pop(F.when(in_window(start, length), F.col("l2"))).alias("variance"))


def eva_scores(metrics: DataFrame, early: int, late: int, length: int = 10) -> DataFrame:
    spread = lambda start: F.var_pop(F.when(in_window(start, length), F.col("l2")))
    return metrics.groupBy("id", "label").agg((spread(early) + spread(late)).alias("score"))


def aum_scores(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("id", "label").agg(F.avg("margin").alias("score"))


def forgetting_scores(metrics: DataFrame) -> DataFrame:
    """How often a correct epoch is followed by an incorrect one."""
    before = F.lag("correct").over(Window.partitionBy("id").orderBy("epoch"))
    steps = metrics.withColumn("lost", (before & ~F.col("correct")).cast("int"))
    return steps.groupBy("id", "label").agg(F.coalesce(F.sum("lost"), F.lit(0)).cast("double").alias("score"))


def el2n_scores(metrics: DataFrame, epochs: int = 20, missing: str = "skip") -> DataFrame:
    """Mean error of the first epochs; with ``missing='zero'`` epochs without a row count as 0."""
    if missing not in ("skip", "zero"):
        raise ValueError("missing must be 'skip' or 'zero'")
    first = metrics.filter(F.col("epoch") <= epochs).groupBy("id", "label")
    return first.agg((F.avg("l2") if missing == "skip" else F.sum("l2") / epochs).alias("score"))


def confidence_stats(metrics: DataFrame, first: int = 11, last: int = 20) -> DataFrame:
    window = metrics.filter(F.col("epoch").between(first, last))
    return window.groupBy("id", "label").agg(F.var_pop("confidence").alias("conf_var"), F.avg("confidence").alias("conf_mean"))


def describe_scores(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: range, moments, percentiles (linear), and how many lie beyond the 10th and 90th."""
    x = F.col(column)
    base = scores.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    base = base.crossJoin(F.broadcast(percentiles(scores, column, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99])))
    joined = scores.select(x.alias("x_")).crossJoin(F.broadcast(base))
    off = F.col("x_") - F.col("mean")
    more = joined.agg(F.avg(off**3).alias("m3"), F.avg(off**4).alias("m4"), F.count_if(F.col("x_") > F.col("p")[4]).alias("above_p90"), F.count_if(F.col("x_") < F.col("p")[0]).alias("below_p10"))
    quantiles = [F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90", "p99"))]
    skew = F.col("m3") / (F.col("std") ** 3 + 1e-8)
    kurtosis = F.col("m4") / (F.col("std") ** 4 + 1e-8) - 3
    return base.crossJoin(more).select("min", "max", "mean", "std", *quantiles, skew.alias("skewness"), kurtosis.alias("kurtosis"), "above_p90", "below_p10")


def dynamics_summary(aum: DataFrame, forgetting: DataFrame) -> DataFrame:
    both = aum.select("id", F.col("score").alias("aum")).join(forgetting.select("id", F.col("score").alias("lost")), "id")
    return both.agg(F.count_if(F.col("aum") < 0).alias("negative_aum"), F.avg((F.col("aum") < 0).cast("double")).alias("negative_share"), F.count_if(F.col("lost") == 0).alias("never_forgotten"), F.count_if(F.col("lost") >= 5).alias("forgotten_5"))


def nearest_window(table: DataFrame, asked: DataFrame, default: tuple[int, int] = (1, 100)) -> DataFrame:
    """``dataset, rate, early, late``: the window of the nearest tabulated rate of the dataset (ties: the lower one)."""
    table = table.select(F.col("dataset").alias("d_"), F.col("rate").alias("r_"), F.col("early").alias("e_"), F.col("late").alias("l_"))
    near = asked.join(table, F.col("dataset") == F.col("d_"), "left")
    best = near.groupBy("dataset", "rate").agg(F.min_by(F.struct("e_", "l_"), F.when(F.col("r_").isNotNull(), F.struct(F.abs(F.col("r_") - F.col("rate")), "r_"))).alias("w"))
    return best.select("dataset", "rate", F.coalesce("w.e_", F.lit(default[0])).alias("early"), F.coalesce("w.l_", F.lit(default[1])).alias("late"))
