"""Files below a folder, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative to the folder), size and modified_at of every file below it; contents are not read.

    An empty folder gives an empty result; files and folders whose names begin with a
    dot or an underscore are hidden, as Spark's readers have it.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    home = home.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(home).toUri().getPath().rstrip("/")
    path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return rows.select(F.substring(path, len(home) + 2, 1 << 30).alias("path"), F.col("length").cast("long").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"))
