"""The test tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as notebooks."""
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    empty = F.array().cast("array<string>")
    id_ = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(id_.alias("id"), F.concat(F.lit("https://notes.example.org/"), id_).alias("url"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.split("p_name", " ").alias("topics"), empty.alias("content_types"), empty.alias("use_cases"), F.array("p_brand").alias("tags"), stamp.alias("created_at"), stamp.alias("updated_at"), F.lit(0).cast("long").alias("use_count"), F.lit(None).cast("timestamp_ntz").alias("last_used"), F.col("p_partkey").alias("ordinal"))


def state(spark: SparkSession, active: str | None = "7") -> DataFrame:
    return spark.range(1).select(F.lit(active).cast("string").alias("active_id"))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.col("l_shipdate").alias("ts"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of one answer per user; errors stand for placeholders."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("text"), (F.col("event_type") == "error").alias("thinking"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; the source decides the top-level entry."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 6
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    path = F.when(n == 0, F.concat(F.lit("browser_state/"), "source", F.lit("/"), name)).when(n == 1, F.lit("sessions.json")).when(n == 2, F.lit("library.json")).when(n == 3, F.lit("auth_info.json")).when(n == 4, F.concat(F.lit("cache/"), name)).otherwise(name)
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("size"))
