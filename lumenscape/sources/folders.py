"""Where tables that a session makes for itself are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that driver and executors share. Only a local session may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lumenscape-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/lumenscape-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
