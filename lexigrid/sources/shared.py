"""The folder that all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder named in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary folder of its own; a
    cluster would lose data in one, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        return tempfile.mkdtemp(prefix="lexigrid")
    return f"{root.rstrip('/')}/lexigrid-{uuid.uuid4().hex[:12]}"


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoints(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the session's own, else one of ``shared_folder``."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark))
