"""The catalogue: search, statistics and changes, as DataFrame functions.

A catalogue is a DataFrame with the columns of ``SCHEMA`` and a one-row DataFrame of
state with the active id.  Changes return new DataFrames; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import parse_list, parse_optional_list, slug

NOTEBOOK = "id string, url string, name string, description string, topics array<string>, content_types array<string>, use_cases array<string>, tags array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, use_count bigint, last_used timestamp_ntz"
SCHEMA = f"{NOTEBOOK}, ordinal bigint"
STATE = "active_id string"
LISTS = ("topics", "content_types", "use_cases", "tags")
PATCHED = ("url", "name", "description", *LISTS)


def _joined(name: str) -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(name), F.array().cast("array<string>")))


def matches(query: str) -> Column:
    """Case-insensitive substring of the name, the description, or a list joined by spaces."""
    wanted = F.lit(query.lower())
    texts = [F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), _joined("topics"), _joined("tags"), _joined("use_cases")]
    found = F.contains(F.lower(texts[0]), wanted)
    for text in texts[1:]:
        found |= F.contains(F.lower(text), wanted)
    return found


def search(catalog: DataFrame, query: str) -> DataFrame:
    """Rows that match, unranked; ``ordinal`` carries the order."""
    return catalog.filter(matches(query))


def search_count(found: DataFrame) -> DataFrame:
    """One row: how many rows a search has found."""
    return found.agg(F.count("*").alias("n_results"))


def get(catalog: DataFrame, id_: str) -> DataFrame:
    return catalog.filter(F.col("id") == id_)


def in_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("ordinal")


def active(catalog: DataFrame, state: DataFrame) -> DataFrame:
    """One row: the active id and its notebook; nulls where the pointer dangles."""
    return state.select("active_id").join(catalog, F.col("active_id") == F.col("id"), "left")


def render(catalog: DataFrame, state: DataFrame) -> DataFrame:
    """A line per notebook: a mark for the active one, topics joined by commas, uses."""
    mark = F.when(F.col("active_id").isNotNull(), " [ACTIVE]").otherwise("")
    return catalog.join(state.select("active_id").filter("active_id is not null"), F.col("active_id") == F.col("id"), "left").select("id", F.concat("name", mark).alias("title"), F.concat_ws(", ", "topics").alias("topics"), F.coalesce("use_count", F.lit(0)).alias("uses"))


def new_rows(requests: DataFrame, now: str) -> DataFrame:
    """Requests (name, url, description, topics, tags, use_cases as text, ordinal) as notebooks; required fields are checked by ``invalid``."""
    stamp = F.lit(now).cast("timestamp_ntz")
    return requests.select(slug(F.col("name")).alias("id"), "url", "name", "description", parse_list(F.col("topics")).alias("topics"), F.array().cast("array<string>").alias("content_types"), parse_optional_list(F.col("use_cases")).alias("use_cases"), parse_optional_list(F.col("tags")).alias("tags"), stamp.alias("created_at"), stamp.alias("updated_at"), F.lit(0).cast("long").alias("use_count"), F.lit(None).cast("timestamp_ntz").alias("last_used"), F.col("ordinal").cast("long").alias("ordinal"))


def first_of_each(rows: DataFrame) -> DataFrame:
    """The earliest row per id.  The smallest ordinal is found first, so that no id's rows are sorted together."""
    low = rows.groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    return rows.join(low, ["id", "ordinal"], "left_semi")


def insert(catalog: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue with the new rows, and the rows rejected because their id is taken."""
    first = first_of_each(rows)
    fresh = first.join(catalog.select("id"), "id", "left_anti").select(*catalog.columns)
    rejected = rows.join(fresh.select("id", "ordinal"), ["id", "ordinal"], "left_anti")
    return catalog.unionByName(fresh), rejected


def activate_only(catalog: DataFrame, state: DataFrame) -> DataFrame:
    """State after an insert: a catalogue of one row makes it active."""
    only = catalog.agg(F.count("*").alias("n"), F.min("id").alias("only"))
    return state.crossJoin(only).select(F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("active_id")).alias("active_id"))


def remove(catalog: DataFrame, id_: str) -> DataFrame:
    return catalog.filter(~F.col("id").eqNullSafe(F.lit(id_)))


def reassign(before: DataFrame, state: DataFrame, id_: str) -> DataFrame:
    """State after ``remove``: if the active one went, the first remaining, or null."""
    left = remove(before, id_).agg(F.min_by("id", "ordinal").alias("next"))
    was = before.filter(F.col("id") == id_).agg(F.count("*").alias("was"))
    return state.crossJoin(left).crossJoin(was).select(F.when((F.col("active_id") == id_) & (F.col("was") > 0), F.col("next")).otherwise(F.col("active_id")).alias("active_id"))


def patch(catalog: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Per changed id: null keeps a field, anything else overwrites it, and updated_at moves.  The id never changes.

    Of several changes for one id, an ``at`` column decides (the last value given per
    field wins); without it, each field takes its largest value.
    """
    fields = [c for c in PATCHED if c in changes.columns]
    at = "at" if "at" in changes.columns else None
    changes = changes.groupBy("id").agg(F.count("*").alias("times"), *[(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))) if at else F.max(c)).alias(c) for c in fields]).drop("times")
    new = changes.select(F.col("id").alias("pid"), *[F.col(c).alias(f"p_{c}") for c in PATCHED if c in changes.columns])
    both = catalog.join(new, F.col("id") == F.col("pid"), "left")
    cols = []
    for c in catalog.columns:
        if c == "updated_at":
            cols.append(F.when(F.col("pid").isNotNull(), F.lit(now).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c))
        else:
            cols.append((F.coalesce(f"p_{c}", c) if f"p_{c}" in both.columns else F.col(c)).alias(c))
    return both.select(*cols)


def unknown(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ids that the catalogue does not have; changes to them are errors."""
    return ids.join(catalog.select("id"), "id", "left_anti")


def activate(catalog: DataFrame, state: DataFrame, id_: str) -> DataFrame:
    """State with the id active, or as it was if there is no such id; ``ok`` says which."""
    there = catalog.filter(F.col("id") == id_).agg((F.count("*") > 0).alias("ok"))
    return state.crossJoin(there).select(F.when(F.col("ok"), F.lit(id_)).otherwise(F.col("active_id")).alias("active_id"), "ok")


def with_usage(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """use_count and last_used from a usage log (id, ts); combined per id before the join."""
    used = log.groupBy("id").agg(F.count("*").alias("use_count"), F.max("ts").alias("last_used"))
    return catalog.drop("use_count", "last_used").join(used, "id", "left").withColumn("use_count", F.coalesce("use_count", F.lit(0)).cast("long"))


def topics_distinct(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("topics").alias("topic")).distinct()


def most_used(catalog: DataFrame) -> DataFrame:
    """The most used row; the first inserted wins ties."""
    return catalog.orderBy(F.desc("use_count"), "ordinal").limit(1)


def stats(catalog: DataFrame, state: DataFrame, path: str | None = None) -> DataFrame:
    """One row: counts, the active notebook if it exists and the most used one (ids, and records), and the catalogue's path."""
    total = catalog.agg(F.count("*").alias("total_notebooks"), F.coalesce(F.sum("use_count"), F.lit(0)).cast("long").alias("total_use_count"))
    topics = topics_distinct(catalog).agg(F.count("*").alias("total_topics"))
    record = F.struct(*catalog.columns)
    now = active(catalog, state).select(F.col("id").alias("active_notebook"), F.when(F.col("id").isNotNull(), record).alias("active_record"))
    top = F.struct(F.coalesce("use_count", F.lit(0)).alias("n"), (-F.col("ordinal")).alias("o"), F.col("id").alias("id"))
    best = catalog.agg(F.max(top).getField("id").alias("most_used_notebook"), F.max_by(record, top).alias("most_used_record"))
    return total.crossJoin(topics).crossJoin(best).crossJoin(now).withColumn("library_path", F.lit(path).cast("string"))


def slug_conflicts(catalog: DataFrame) -> DataFrame:
    """Slugs that several names share, with how many rows."""
    return catalog.groupBy(slug(F.col("name")).alias("slug")).agg(F.count("*").alias("n"), F.min_by("id", "ordinal").alias("first_id")).filter("n > 1")
