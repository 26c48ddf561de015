"""The shared folder for tables and checkpoints that cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpointed(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``; a temporary folder only where neither is set and the master is local."""
    context = spark.sparkContext
    given = context.getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or given
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tablewright-")
    if given is None:
        context.setCheckpointDir(found)
    return found
