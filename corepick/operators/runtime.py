"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that ``spark.checkpoint.dir`` names; a temporary one in local mode only."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not shared and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corepick-checkpoint-"))
    return df.checkpoint(eager=True)
