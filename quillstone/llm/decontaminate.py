"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``WINDOW`` consecutive words of the benchmark items;
an item of fewer words is one shorter pattern.  Patterns of one length share two
tables: a *shift* table from a block (two neighbouring words) to the distance that
the search may skip, and *suffix buckets*, which for a block that ends a pattern
name the patterns to test, by first word.  A direct comparison confirms each.

The items are a query set: they are gathered in blocks of at most
``BLOCK_CHARS`` characters, each block passes over all documents in one narrow
scan, and passes are chained without a shuffle.

Words: A-Z become a-z, then every stretch of non-ASCII characters, digits and
ASCII letters is a word.

Edge cases: null and empty texts have no words, so no hits; an item without words
has no window; items that share an item_id count once; a null item_id counts as an
item whose text form is empty; repeated documents each get their row; other columns
are ignored; with an empty benchmark nothing is hit; with an empty table the result
is empty.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Keyed, Texts, resident, two_columns

WINDOW = 10
BLOCK_CHARS = 8_000_000

_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


class _Group:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, size: int):
        self.size, self.block = size, min(2, size)
        self.skip = size - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}

    def add(self, pattern: list[bytes], item: str) -> None:
        m, b = self.size, self.block
        for end in range(b, m + 1):
            key = tuple(pattern[end - b : end])
            self.shift[key] = min(self.shift.get(key, self.skip), m - end)
        bucket = self.buckets.setdefault(tuple(pattern[-b:]), {}).setdefault(pattern[0], [])
        for known, items in bucket:
            if known == pattern:
                items.add(item)
                return
        bucket.append((pattern, {item}))

    def search(self, words: list[bytes], hit: bytearray | None, items: set[str]) -> bytearray | None:
        m, n, at = self.size, len(words), self.size - 1
        get, skip = self.shift.get, self.skip
        two = self.block == 2
        while at < n:
            key = (words[at - 1], words[at]) if two else (words[at],)
            jump = get(key, skip)
            if jump:
                at += jump
                continue
            begin = at - m + 1
            for pattern, found in self.buckets[key].get(words[begin], ()):
                if words[begin : at + 1] == pattern:
                    items |= found
                    if hit is None:
                        hit = bytearray(n)
                    hit[begin : at + 1] = b"\1" * m
            at += 1
        return hit


class Searcher:
    """All patterns of a block of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        groups: dict[int, _Group] = {}
        for item, text in items:
            words = words_of(text)
            m = min(window, len(words))
            for k in range(len(words) - m + 1 if m else 0):
                groups.setdefault(m, _Group(m)).add(words[k : k + m], item)
        self.groups = list(groups.values())

    def __call__(self, words: list[bytes], hit: bytearray | None = None, items: set[str] | None = None) -> tuple[bytearray | None, set[str]]:
        items = set() if items is None else items
        for group in self.groups:
            hit = group.search(words, hit, items)
        return hit, items


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int):
    """The query set in blocks; which block an item is in depends on its hash alone."""
    two = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    total = two.agg(F.sum(F.length("text") + 50)).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    for k in range(n):
        part = two if n == 1 else two.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()], k == n - 1


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    return scan(two_columns(docs, id_col, text_col), items, item_id_col, item_text_col, window, block_chars)


def scan(docs: DataFrame, items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep_text: bool = False) -> DataFrame:
    """As ``decontaminate``; all other columns of ``docs`` stay, the text on demand."""
    spark = docs.sparkSession
    names = ["hit_flags", "hit_items", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    rest = [c for c in docs.columns if c != "text"]
    types = dict(docs.dtypes)
    first = True
    for block, last in _blocks(items, item_id_col, item_text_col, block_chars):
        held = Keyed(spark.sparkContext.broadcast((block, window)))
        out = [*rest, *(["text"] if keep_text or not last else []), *(names[2:] if last else names[:2])]

        def run(batches, held=held, last=last, first=first, out=out):
            search = resident(("searcher", held), lambda: Searcher(*held.value))
            for batch in batches:
                for a, b, texts in Texts(batch.column("text")).slices():
                    rows = {c: [] for c in names}
                    before = [(None, None)] * (b - a) if first else zip(batch.column("hit_flags").slice(a, b - a).to_pylist(), batch.column("hit_items").slice(a, b - a).to_pylist(), strict=True)
                    for text, (flags, had) in zip(texts.strings(), before, strict=True):
                        words = words_of(text)
                        hit, found = search(words, bytearray(flags) if flags else None, set(had or ()))
                        n_hit = sum(hit) if hit else 0
                        if last:
                            row = (None, None, len(words), n_hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n_hit > 0)
                        else:
                            row = (bytes(hit) if hit else None, sorted(found), None, None, None, None, None)
                        for c, x in zip(names, row, strict=True):
                            rows[c].append(x)
                    made = dict(zip(names, (pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[c], made[c]) if c in made else batch.column(c).slice(a, b - a) for c in out], names=out)

        kinds = types | dict(zip(names, ("binary", "array<string>", "bigint", "bigint", "bigint", "string", "boolean"), strict=True))
        docs = docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in out))
        first = False
    return docs
