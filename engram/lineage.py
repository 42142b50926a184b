"""Cutting of long lineages in the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a session of one machine may do without, and gets its own folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="engram-checkpoint-")
    context.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
