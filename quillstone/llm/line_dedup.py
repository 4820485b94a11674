"""Line dedup by overlapping three-line windows, in Spark SQL functions alone.

Every three consecutive lines that are not blank form a window, identified by 128
bits of hash.  Windows are counted globally; for those found more than once, the
first occurrence in order of (doc_id, hash of text, place) stays, and the lines of
all later occurrences, merged into one set of places per document, are removed.
Blank lines do not count for windows; one inside a removed window goes with it.

The windows are made once and written down.  A hot window never meets in one task:
each row of the table is dealt one of ``SALTS`` numbers, occurrences are counted per
window and number first, and the few partial results of a window are put together
and sent back to its numbers, where the occurrences are picked.

Edge cases: null and empty texts stay as they are; a text of fewer than three lines
that are not blank is never changed; rows that repeat both id and text are treated as
one document, and get the same result; rows with null ids come first in the order; a
text whose lines are all removed becomes empty; other columns pass through, but one
named like a result column is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Stage

WINDOW, SALTS = 3, 64
_ALL = 2147483647


def _windows(docs: DataFrame) -> DataFrame:
    """h1, h2, salt, place (doc_id, tie, first and last line): a row per window."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    full = F.filter(lines, lambda s: F.length(F.trim(F.translate(s["x"], "\t\r\x0b\x0c", "    "))) > 0)
    # explode(array()) keeps the optimiser from computing the array again for each use
    rows = docs.filter(F.instr("text", "\n") > 0).select("doc_id", "tie", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.array(full)).alias("ls")).filter(F.size("ls") >= WINDOW)
    parts = [F.slice("ls", k + 1, _ALL).alias(f"l{k}") for k in range(WINDOW)]
    rows = rows.select("doc_id", "tie", "salt", F.inline(F.slice(F.arrays_zip(*parts), 1, F.size("ls") - (WINDOW - 1))))
    xs = [F.col(f"l{k}.x") for k in range(WINDOW)]
    return rows.select(F.xxhash64(*xs).alias("h1"), F.xxhash64(F.lit(7), *xs).alias("h2"), "salt", "doc_id", "tie", F.col("l0.i").alias("a"), F.col(f"l{WINDOW - 1}.i").alias("b"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with the text shortened, and n_lines, n_removed (long)."""
    if text_col.lower() in ("n_lines", "n_removed") or id_col.lower() in ("n_lines", "n_removed"):
        raise ValueError("the id or the text has the name of a result column")
    names = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    windows = Stage(df.sparkSession)(_windows(docs), "line-windows")
    place = F.struct("doc_id", "tie", "a")
    parts = windows.groupBy("h1", "h2", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    all_parts = Window.partitionBy("h1", "h2")  # at most SALTS rows
    parts = parts.select("h1", "h2", "salt", F.sum("n").over(all_parts).alias("n"), F.min("first").over(all_parts).alias("first"))
    later = windows.join(parts.filter("n > 1"), ["h1", "h2", "salt"]).filter(~place.eqNullSafe(F.col("first")))
    gone = later.select("doc_id", "tie", F.explode(F.sequence("a", "b")).alias("at")).groupBy("doc_id", "tie").agg(F.collect_set("at").alias("gone"))

    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("tie"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie"), "gone")
    both = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("tie") == F.col("gone_tie")), "left")
    text = F.col("row").getField(text_col).cast("string")
    both = both.select("row", "gone", F.explode(F.array(F.split(text, "\n", -1))).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    short = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    n = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    out = both.select(*[(F.when(F.col("gone").isNotNull(), short).otherwise(text) if c == text_col else F.col("row").getField(c)).alias(c) for c in names], F.when(text.isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return out
