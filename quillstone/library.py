"""A catalogue kept as an append-only change log in a folder of Parquet files.

Writers append change rows and never rewrite one another's; a reader folds the log to
the latest version of each id.  An id keeps the place of its first insert.  Every
change carries the time that the caller gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import catalog

#: seq orders changes: the caller's time, then a random tie-breaker that is stored with the row.
_LOG = f"op string, at timestamp_ntz, seq string, {catalog.NOTEBOOK}"


class Library:
    """Search, statistics and changes over a change log at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], _LOG)

    def _append(self, rows: DataFrame, op: str, now: str) -> None:
        names = [f.name for f in self.spark.createDataFrame([], _LOG).schema.fields]
        rows.withColumns({"op": F.lit(op), "at": F.lit(now).cast("timestamp_ntz"), "seq": F.expr("uuid()")}).select(*names).write.mode("append").parquet(f"{self.path}/log")

    def notebooks(self) -> DataFrame:
        """The current catalogue.  The latest change per id wins; usage rows are counted."""
        log = self._log().filter("op <> 'activate'")
        order = F.struct("at", "seq")
        state = log.filter("op <> 'use'")
        last = state.groupBy("id").agg(F.max(F.struct("at", "seq")).alias("last"), F.min(F.when(F.col("op") == "insert", order)).alias("first"), F.max(F.when(F.col("op") == "remove", order)).alias("removed"))
        now = state.join(last, "id").filter(order == F.col("last")).filter("op <> 'remove'").drop("op", "use_count", "last_used")
        started = state.filter("op = 'insert'").join(last.select("id", "removed"), "id").filter(F.col("removed").isNull() | (order > F.col("removed")))
        started = started.groupBy("id").agg(F.min(order).alias("begun"))
        uses = log.filter("op = 'use'").join(started, "id").filter(order > F.col("begun")).select("id", F.col("at").alias("ts"))
        rows = now.join(started, "id").withColumn("ordinal", F.unix_micros(F.col("begun.at").cast("timestamp")))
        with_use = catalog.with_usage(rows.select("*", F.lit(0).alias("use_count"), F.lit(None).alias("last_used")), uses)
        return with_use.select(*[f.strip().split(" ")[0] for f in catalog.SCHEMA.split(", ")])

    def state(self) -> DataFrame:
        """The active id: the last one activated if it is still there, else the first notebook."""
        rows = self.notebooks()
        chosen = self._log().filter("op = 'activate'").agg(F.max_by("id", F.struct("at", "seq")).alias("chosen"))
        there = rows.select(F.col("id").alias("chosen"), F.lit(True).alias("there"))
        first = rows.agg(F.min_by("id", F.struct("ordinal", "id")).alias("first"))
        return chosen.join(there, "chosen", "left").crossJoin(first).select(F.when(F.col("there"), F.col("chosen")).otherwise(F.col("first")).alias("active_id"))

    def _require(self, id_: str) -> None:
        if not catalog.get(self.notebooks(), id_).limit(1).count():
            raise ValueError(f"no notebook with the id {id_!r}")

    def add(self, url: str, name: str, description: str, topics: list[str], now: str, content_types: list[str] | None = None, use_cases: list[str] | None = None, tags: list[str] | None = None) -> str:
        """Insert a notebook and return its id; an id that is taken raises."""
        from quillstone.functions.text import slug

        row = self.spark.createDataFrame([(url, name, description, topics, content_types or [], use_cases or [], tags or [])], "url string, name string, description string, topics array<string>, content_types array<string>, use_cases array<string>, tags array<string>")
        stamp = F.lit(now).cast("timestamp_ntz")
        row = row.withColumns({"id": slug(F.col("name")), "created_at": stamp, "updated_at": stamp, "use_count": F.lit(0).cast("long"), "last_used": F.lit(None).cast("timestamp_ntz")})
        id_ = row.first().id
        if catalog.get(self.notebooks(), id_).limit(1).count():
            raise ValueError(f"the id {id_!r} is taken")
        self._append(row, "insert", now)
        return id_

    def update(self, id_: str, now: str, **changes) -> None:
        """Overwrite the fields given (None keeps); the id stays."""
        self._require(id_)
        unknown = set(changes) - set(catalog.PATCHED)
        if unknown:
            raise ValueError(f"no such fields: {sorted(unknown)}")
        given = {k: v for k, v in changes.items() if v is not None}
        fields = ", ".join(f"{k} {'array<string>' if k in catalog.LISTS else 'string'}" for k in given)
        patch = self.spark.createDataFrame([(id_, *given.values())], "id string" + (f", {fields}" if fields else ""))
        self._append(catalog.patch(catalog.get(self.notebooks(), id_), patch, now), "update", now)

    def remove(self, id_: str, now: str) -> bool:
        found = catalog.get(self.notebooks(), id_)
        if not found.limit(1).count():
            return False
        self._append(found, "remove", now)
        return True

    def activate(self, id_: str, now: str) -> None:
        self._require(id_)
        self._append(catalog.get(self.notebooks(), id_), "activate", now)

    def use(self, id_: str, now: str) -> None:
        """Count one use; concurrent uses all count."""
        self._require(id_)
        self._append(catalog.get(self.notebooks(), id_), "use", now)

    def get(self, id_: str) -> DataFrame:
        return catalog.get(self.notebooks(), id_)

    def list(self) -> DataFrame:
        return catalog.in_order(self.notebooks())

    def search(self, query: str) -> DataFrame:
        return catalog.in_order(catalog.search(self.notebooks(), query))

    def stats(self) -> DataFrame:
        return catalog.stats(self.notebooks(), self.state(), self.path)
