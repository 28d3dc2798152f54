"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset and the driver runs
    all tasks, as in tests, a folder of this machine is set for checkpoints and returned; on a cluster that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    folder = "file://" + tempfile.mkdtemp(prefix="siltwork-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
