"""Storage roll-ups: classify top-level entries, sum sizes, format, preview.  Nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import format_size, title

#: The categories, and the top-level entries that have one of their own.
CATEGORIES = ("browser_state", "sessions", "library", "auth", "other")
KNOWN = {"browser_state": "browser_state", "sessions.json": "sessions", "library.json": "library", "auth_info.json": "auth"}


def classify(name: Column) -> Column:
    """The category of a top-level entry."""
    out = F.lit("other")
    for entry, category in KNOWN.items():
        out = F.when(name == entry, category).otherwise(out)
    return out


def items(files: DataFrame) -> DataFrame:
    """Files (path relative to the data folder, size) as items (category, path, size, type).

    Children of the browser-state folder are items of their own; any other folder is
    one item, with the sizes of the files below it added up.
    """
    parts = F.split("path", "/")
    top = F.get(parts, F.lit(0))
    inside = top == "browser_state"
    path = F.when(inside, F.concat_ws("/", top, F.get(parts, F.lit(1)))).otherwise(top)
    depth = F.when(inside, 2).otherwise(1)
    kind = F.when(F.size(parts) > depth, "dir").otherwise("file")
    rows = files.select(classify(top).alias("category"), path.alias("path"), kind.alias("type"), "size")
    return rows.groupBy("category", "path", "type").agg(F.sum("size").cast("long").alias("size"))


def preserving(rows: DataFrame, preserve_library: bool = False) -> DataFrame:
    return rows.filter("category <> 'library'") if preserve_library else rows


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n_items"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_items"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def dir_size(files: DataFrame, prefix: str) -> DataFrame:
    """The bytes of all files below a folder, or of the one file of that name."""
    return files.filter((F.col("path") == prefix) | F.startswith("path", F.lit(prefix.rstrip("/") + "/"))).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))


def dry_run(rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(True).alias("dry_run"), F.count("*").alias("would_delete"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("would_free"))


def preview(rows: DataFrame) -> DataFrame:
    """Categories that have items, with titles and readable sizes."""
    return by_category(rows).select(title(F.col("category")).alias("title"), "n_items", format_size(F.col("total_size")).alias("size_text"))
