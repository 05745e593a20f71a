"""Selections as tables with a manifest: ids, order, counts and a digest that tells tampering.

A write goes to a folder of its own below ``selections``; its manifest, written last, is what makes it count. Readers take the
folder that the last manifest of a configuration names, so a write that was broken off is never seen, one that replaces
another is seen whole or not at all, and one that says the same again changes nothing.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = ("dataset", "ratio_bp", "method", "embedding", "seed", "trial")
#: Ranks of one block are digested by one task; block digests are digested in order.
BLOCK = 100_000


def digest_of(selection: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per ``keys``: ``n``, ``digest`` (SHA-256 over the ids in order of rank; over block digests where there are several blocks)."""
    blocks = selection.withColumn("block_", F.floor((F.col("rank") - 1) / BLOCK)).groupBy(*keys, "block_").agg(
        F.count("*").alias("n"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), "\n"), 256).alias("d"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_", "d"))), lambda x: x["d"])
    joined = blocks.groupBy(*keys).agg(F.sum("n").alias("n"), ordered.alias("ds"))
    return joined.select(*keys, "n", F.when(F.size("ds") == 1, F.get("ds", 0)).otherwise(F.sha2(F.array_join("ds", "\n"), 256)).alias("digest"))


def check_ids(selection: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per ``keys`` whether ids are there, not negative, and unique: ``valid``."""
    bad = F.min("id").isNull() | (F.min("id") < 0) | (F.count("*") != F.count_distinct("id"))
    return selection.groupBy(*keys).agg((~bad).alias("valid"))


def write_selection(selection: DataFrame, base: str, config: dict[str, object]) -> DataFrame:
    """Store ``id, label, rank`` and its manifest under ``config``; ids that repeat or are negative are an error."""
    if not check_ids(selection).first().valid:
        raise ValueError("ids must be unique and not negative")
    spark, folder = selection.sparkSession, uuid.uuid4().hex
    tagged = selection.select("id", "label", "rank", *(F.lit(config[c]).alias(c) for c in CONFIG))
    new, old = digest_of(tagged, CONFIG).first(), _of(read_manifests(spark, base), config).first()
    if old is None or new is None or old.digest != new.digest:
        tagged.write.parquet(f"{base}/selections/write={folder}")
        written = digest_of(spark.read.parquet(f"{base}/selections/write={folder}"), CONFIG)
        written.select("*", F.lit(folder).alias("folder"), F.lit(time.time_ns()).alias("written")).write.mode("append").parquet(f"{base}/manifests")
    return _of(read_manifests(spark, base), config)


def read_manifests(spark: SparkSession, base: str) -> DataFrame:
    """The last manifest of each configuration: its columns, ``n``, ``digest``, ``folder``, ``written``."""
    try:
        every = spark.read.parquet(f"{base}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kinds = "dataset string, ratio_bp string, method string, embedding string, seed int, trial int, n long, digest string, folder string, written long"
        return spark.createDataFrame([], kinds)
    last = every.groupBy(*CONFIG).agg(F.max_by(F.struct("n", "digest", "folder", "written"), F.struct("written", "folder")).alias("m"))
    return last.select(*CONFIG, "m.*")


def read_selections(spark: SparkSession, base: str) -> DataFrame:
    """All selections that count."""
    last = read_manifests(spark, base).select(F.col("folder").alias("write"))
    return spark.read.parquet(f"{base}/selections").join(last, "write", "left_semi").drop("write")


def _of(df: DataFrame, config: dict[str, object]) -> DataFrame:
    for c in CONFIG:
        df = df.filter(F.col(c) == config[c])
    return df


def read_selection(spark: SparkSession, base: str, config: dict[str, object], expected_digest: str | None = None) -> DataFrame:
    """A stored selection; one whose digest is not the expected one is an error."""
    last = _of(read_manifests(spark, base), config).first()
    if last is None:
        raise ValueError(f"no selection of {config}")
    df = spark.read.parquet(f"{base}/selections/write={last.folder}")
    if expected_digest is not None:
        found = digest_of(df).first()
        if found is None or found.digest != expected_digest:
            raise ValueError("digest mismatch")
    return df.select("id", "label", "rank")


def verify_selections(selections: DataFrame, manifests: DataFrame, keys: tuple[str, ...] = CONFIG) -> DataFrame:
    """Per configuration a ``status``: ok, missing (manifest only), unlisted (selection only), count or digest."""
    have = digest_of(selections, keys).withColumnsRenamed({"n": "n_", "digest": "digest_"})
    both = manifests.select(*keys, "n", "digest").join(have, list(keys), "full")
    status = F.when(F.col("n_").isNull(), "missing").when(F.col("n").isNull(), "unlisted").when(F.col("n") != F.col("n_"), "count").when(F.col("digest") != F.col("digest_"), "digest").otherwise("ok")
    return both.select(*keys, status.alias("status"))
