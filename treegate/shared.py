"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names, or the session's checkpoint folder.

    Only a session that is all in one machine may have neither: a temporary folder is
    then made and set. On a cluster that raises, as executors would not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    at = tempfile.mkdtemp(prefix="treegate-")
    atexit.register(shutil.rmtree, at, True)
    spark.sparkContext.setCheckpointDir(f"file://{at}")
    return f"file://{at}"
