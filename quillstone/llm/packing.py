"""Packing by optimal length buckets.

Documents are token counts plus one end token.  Those longer than ``max_len`` are cut
into full pieces and a rest, so every length lies in 1..max_len, and the global
histogram of lengths, which is all that the driver sees, has at most ``max_len``
entries.  Dynamic programming over it chooses the bucket boundaries that minimise the
padding.  Inside a bucket, pieces are numbered without gaps and cut into batches of
``budget`` tokens (padded length times rows).

Numbering does not gather a bucket: pieces are dealt into shards of about
``SHARD_ROWS`` rows by a hash of their row's number in the staged table of lengths,
so that a much repeated id, or none, is split like any other; they are numbered
inside the shard, and shifted by the sizes of the shards before it (one row per
shard).

A piece is the tokens from ``start`` on, ``n_tokens`` of them, of its document's
tokens and end token; with the ids of ``token_files`` (of the same tokenizer) a batch
can be built from that.

Edge cases: null and empty texts hold the end token alone; repeated rows and null ids
are packed each for itself; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Stage, two_columns
from .token_counts import with_token_counts

MAX_LEN, BUCKETS, BUDGET, SHARD_ROWS = 2048, 8, 65536, 2000


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding in all."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if not n:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    came = np.zeros((min(buckets, n), n + 1), np.int64)
    for k in range(len(came)):
        new = np.full(n + 1, np.iinfo(np.int64).max // 4)
        for end in range(1, n + 1):
            cost = best[:end] + x[end - 1] * (rows[end] - rows[:end]) - (tokens[end] - tokens[:end])
            came[k, end] = b = int(cost.argmin())
            new[end] = cost[b]
        best = new
    bounds, end = [], n
    for k in range(len(came) - 1, -1, -1):
        bounds.append(int(x[end - 1]))
        end = int(came[k, end])
    return sorted(set(bounds))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket_len, batch_id, slot: one row per piece."""
    docs = with_token_counts(two_columns(df, id_col, text_col), "text", tokenizer, keep_text=False)
    return pack_lengths(docs.select("doc_id", (F.col("n_tokens") + 1).alias("n")), max_len, buckets, budget, shard_rows)


def pack_lengths(lengths: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """As ``pack``, from (doc_id, n), where n is at least 1."""
    numbered = lengths.select("doc_id", "n", F.monotonically_increasing_id().alias("row"))
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / max_len).cast("int")))
    pieces = Stage(lengths.sparkSession)(numbered, "lengths").select("doc_id", "n", "row", cut.alias("piece"))
    pieces = pieces.select("doc_id", "row", F.col("piece").cast("long").alias("piece"), F.least(F.col("n") - F.col("piece") * max_len, F.lit(max_len)).cast("long").alias("n_tokens"))
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most max_len rows
    x = np.asarray(sorted(histogram), np.int64)
    c = np.asarray([histogram[k] for k in x.tolist()], np.int64)
    bounds = best_boundaries(x, c, buckets)
    bucket = rows = shards = first = F.lit(None).cast("long")
    begun, low = 0, 0
    plan = []
    for b in bounds:
        n = int(c[(x > low) & (x <= b)].sum())
        per = max(1, budget // b)
        plan.append((b, per, max(1, -(-n // shard_rows)), begun))
        begun += -(-n // per)
        low = b
    for b, per, parts, at in reversed(plan):
        inside = F.col("n_tokens") <= b
        bucket, rows, shards, first = (F.when(inside, F.lit(v).cast("long")).otherwise(old) for v, old in ((b, bucket), (per, rows), (parts, shards), (at, first)))
    dealt = pieces.select("doc_id", "row", "piece", "n_tokens", bucket.alias("bucket_len"), rows.alias("rows"), first.alias("first"), F.xxhash64("row", "piece").alias("h"), shards.alias("shards"))
    dealt = dealt.withColumn("shard", F.pmod("h", "shards"))
    sizes = dealt.groupBy("bucket_len", "shard").count()
    before = F.sum("count").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("bucket_len", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("h", "row", "piece"))
    numbered = dealt.withColumn("place", place - 1).join(starts, ["bucket_len", "shard"])
    rank = F.col("before") + F.col("place")
    return numbered.select("doc_id", "piece", (F.col("piece") * max_len).alias("start"), "n_tokens", "bucket_len", (F.col("first") + F.floor(rank / F.col("rows"))).cast("long").alias("batch_id"), (rank % F.col("rows")).cast("long").alias("slot"))
