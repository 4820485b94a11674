"""The catalogue file: one JSON object with notebooks by id, the active id, and a stamp."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1000  # ordinals a document, where a catalogue is written as many
_NOTEBOOK = "id string, url string, name string, description string, topics array<string>, content_types array<string>, use_cases array<string>, tags array<string>, created_at string, updated_at string, use_count bigint, last_used string"
DOCUMENT = f"notebooks map<string, struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _NOTEBOOK.split(', '))}>>, active_notebook_id string, updated_at string"


class CorruptLibrary(ValueError):
    """The file holds no catalogue; it is left as it is."""


def parse(documents: DataFrame) -> DataFrame:
    """Add ``doc``, parsed with the explicit schema, to rows with ``value``."""
    return documents.withColumn("doc", F.from_json("value", DOCUMENT))


def read_library(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(catalogue, state) of a file.  A file that cannot be parsed reads as empty, or raises with ``strict``."""
    text = parse(spark.read.text(path, wholetext=True))
    if strict and text.filter("doc.notebooks is null").limit(1).count():
        raise CorruptLibrary(path)
    rows = text.select(F.posexplode(F.coalesce("doc.notebooks", _empty())).alias("ordinal", "key", "n"))
    return _notebooks(rows), text.select(F.col("doc.active_notebook_id").alias("active_id"))


def _empty() -> Column:
    return F.expr("map()").cast("map<string, struct<" + DOCUMENT.split("struct<", 1)[1].split(">>, active", 1)[0] + ">>")


def _notebooks(rows: DataFrame) -> DataFrame:
    """Rows (ordinal, key, n), where n is a parsed notebook, as a catalogue."""
    lists = {c: F.coalesce(f"n.{c}", F.array().cast("array<string>")).alias(c) for c in ("topics", "content_types", "use_cases", "tags")}
    stamps = {c: F.try_to_timestamp(f"n.{c}").cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at", "last_used")}
    names = ["id", "url", "name", "description", "topics", "content_types", "use_cases", "tags", "created_at", "updated_at", "use_count", "last_used"]
    return rows.select(*[F.col("key").alias("id") if c == "id" else lists.get(c, stamps.get(c, F.col(f"n.{c}"))) for c in names], F.col("ordinal").cast("long").alias("ordinal"))


def _documents(catalog: DataFrame, state: DataFrame, now: str, *by: str) -> DataFrame:
    """Rows ``by`` and ``value``: a document per group, in insertion order."""
    iso = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) for c in ("created_at", "updated_at", "last_used")}
    cols = [c for c in catalog.columns if c not in ("ordinal", *by)]
    row = F.struct(*[iso.get(c, F.col(c)) for c in cols])
    groups = catalog.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col("id").alias("key"), row.alias("n")))).alias("rows"))
    notebooks = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["key"], r["n"])))
    return groups.crossJoin(state).select(*by, F.to_json(F.struct(notebooks.alias("notebooks"), F.col("active_id").alias("active_notebook_id"), F.lit(now).alias("updated_at"))).alias("value"))


def to_json(catalog: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """One row ``value``: the document, in insertion order.  A catalogue file holds all notebooks, so this gathers them."""
    return _documents(catalog, state, now).select("value")


def to_json_blocks(catalog: DataFrame, state: DataFrame, now: str, block: int = BLOCK) -> DataFrame:
    """Rows ``value`` and ``before``: a document per ``block`` ordinals, and how many notebooks stand in those before it.

    No task holds more than the notebooks of a block; only the blocks' sizes are
    gathered, to number across gaps.
    """
    parts = _documents(catalog.withColumn("block", F.floor(F.col("ordinal") / block)), state, now, "block")
    sizes = catalog.groupBy(F.floor(F.col("ordinal") / block).alias("of")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("of", F.coalesce(before, F.lit(0)).alias("before"))
    return parts.join(sizes, F.col("block").eqNullSafe(F.col("of"))).select("value", "before")


def write_library(catalog: DataFrame, state: DataFrame, folder: str, now: str) -> str:
    """Write a new version beside the older ones and return its path; nothing is overwritten."""
    path = f"{folder.rstrip('/')}/version={now.replace(':', '-')}-{uuid.uuid4().hex[:8]}"
    to_json(catalog, state, now).coalesce(1).write.text(path)
    return path


def write_blocks(catalog: DataFrame, state: DataFrame, folder: str, now: str, block: int = BLOCK) -> str:
    """Write a catalogue of any size as many documents, one file each, below ``before=N`` folders; returns the folder."""
    to_json_blocks(catalog, state, now, block).write.partitionBy("before").text(folder)
    return folder


def read_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(catalogue, state) of what ``write_blocks`` wrote: documents are parsed in parallel, and ordinals go on across them."""
    text = parse(spark.read.schema("value string, before bigint").text(folder, wholetext=True))
    catalog = _notebooks(text.select("before", F.posexplode(F.coalesce("doc.notebooks", _empty())).alias("at", "key", "n")).withColumn("ordinal", F.col("before") + F.col("at")))
    return catalog, text.filter("before = 0").select(F.col("doc.active_notebook_id").alias("active_id"))
