"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else the one that the context was given.

    A machine's own folder serves only where driver and executors are one process, as in tests; on a
    cluster without a shared folder executors would lose what others wrote, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "pathwise-checkpoints")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage.

    The rows are computed once, later reads survive lost executors, and the order and partition of
    the rows are those of ``df``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
