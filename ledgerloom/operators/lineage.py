"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, as a checkpoint's own folder within it.

    Only a session on this machine that names no folder (tests) gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", "")
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return sc.getCheckpointDir()


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder, so that lost executors and long plans do no harm."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
