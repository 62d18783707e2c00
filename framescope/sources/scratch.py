"""A folder for tables between jobs, seen by driver and executors alike."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new name under spark.checkpoint.dir, in this application's folder. Where none is named, a local
    session gets one that goes with the process; a cluster has none to offer."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="framescope-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
