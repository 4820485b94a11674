"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place below the folder that a cluster names in ``spark.checkpoint.dir``; only a local master may leave that unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillstone-")
    return f"{found.rstrip('/')}/quillstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
