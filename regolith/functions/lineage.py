"""Cutting the lineage of loops, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir or the checkpoint folder already set. Where neither is, a
    temporary one on a local master (tests); on a cluster that is an error, since executors would not see the driver's disk."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="regolith-")
    if held.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once into the shared folder, so that loops stay short to plan and survive the loss of an
    executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
