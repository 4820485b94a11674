"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters.

A dataset is a folder with two ORC tables.  ``tokens`` has one row per document in
ascending order of (doc_id, hash of text, text): shard, doc_id, start_in_shard,
n_tokens and the ids as ``array<int>``, which ORC stores as run-length-encoded
integers.  Row indexes (every ``row_index_stride`` rows) and Bloom filters on doc_id
let a reader skip stripes and row groups; Spark reads the stripes in parallel.
``shards`` has one row per range partition with the number of ids before it, so no
writer waits for another.

Texts are cut into stretches in numpy, and these are told apart in Arrow; each
different one is encoded by the tokenizers library once and its ids are remembered
(in bounded number and bytes, then all are dropped).  Cuts lie at spaces and line
breaks, and besides between letters, digits and marks where the tokenizer's split
pattern begins a match whatever stands around.  That equals encoding the whole text
only for some tokenizers, which ``Encoder`` makes out from the tokenizer's file; else
it cuts at less, or not at all.

Edge cases: null and empty texts hold the end id alone; null doc_ids come first;
repeated ids and rows each keep their own row; special strings inside texts become
their ids, as is the library's default; other columns are ignored; an empty table
gives an empty dataset.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Texts, Words, appended, as_texts, new_path, ragged, resident, two_columns

MAX_MEMO, MAX_MEMO_BYTES = 700_000, 32 << 20
LONG_WORD = 256  # bytes beyond which a stretch is not remembered
PART_BYTES = 2 << 20  # of texts, and of a longer text up to the next space, that are taken at a time
END_ID = 1

_INSIDE = np.ones(256, bool)
_INSIDE[[10, 32]] = False
#: Classes of bytes: letter, digit, mark, apostrophe; 0 for all that is never cut at (special strings are made of <|>).
_LETTER, _DIGIT, _MARK, _QUOTE = 1, 2, 3, 4
_CLASS = np.asarray([_LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _QUOTE if c == 39 else _MARK if 32 < c < 127 and chr(c) not in "<|>_" else 0 for c in range(128)] + [0] * 128, np.uint8)
#: Whether the split pattern always begins a match between two classes, whatever stands around them.
_CUT = np.zeros(40, bool)
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _MARK), (_LETTER, _QUOTE), (_DIGIT, _LETTER), (_DIGIT, _DIGIT), (_DIGIT, _MARK), (_DIGIT, _QUOTE), (_MARK, _LETTER), (_MARK, _DIGIT), (_QUOTE, _DIGIT)):
    _CUT[_a * 8 + _b] = True
_LOWER = np.asarray([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: What the cuts and the lower-casing above presume of a tokenizer's file.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_STEPS = ["NFC", "Replace", "Lowercase"]


def _classes(raw: np.ndarray) -> np.ndarray:
    found = _CLASS[raw]
    at = np.flatnonzero(raw[:-1] == 0xC3)  # the letters of Latin-1, two bytes each
    at = at[(raw[at + 1] != 0x97) & (raw[at + 1] != 0xB7)]
    found[at] = found[at + 1] = _LETTER
    return found


class Encoder:
    """Texts to ids: one flat array and the number of ids of each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        dropped = [s for s in splits if s["type"] == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
        self.by_word = bool(dropped) and all("\\s" not in s["pattern"]["Regex"].replace("[^\\s", "") for s in dropped)
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        special = all(t["content"].startswith("<|") and set(t["content"]) <= set("<|>_abcdefghijklmnopqrstuvwxyz") for t in spec["added_tokens"])
        self.by_class = self.by_word and special and steps == _STEPS and [s["pattern"]["Regex"] for s in dropped] == [_PATTERN]
        self.reset()

    def reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.held = 0  # bytes of the stretches in memo
        #: The remembered stretches' ids one after the other, and where each stretch's begin and how many they are.
        self.ids = np.full(1, END_ID, np.int32)
        self.begins, self.sizes = np.zeros(1, np.int64), np.ones(1, np.int64)  # the first stands for the end of a text
        self.n_ids = self.n_words = 1

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        """A stretch of small ASCII letters is its own normal form and one piece, so the library's model alone encodes it."""
        model, found = self.tokenizer.model.tokenize, [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            if self.by_class and w.isalpha() and w.islower():  # of bytes: ASCII letters alone
                found[k] = [t.id for t in model(w.decode())]
            else:
                rest.append(k)
        for k, ids in zip(rest, self._whole([words[k].decode() for k in rest]), strict=True):
            found[k] = ids
        return found

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The place of each of some different stretches in the table, after those that are new have been added."""
        known = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        if len(new):
            added = [words[k] for k in new.tolist()]
            found = self._encoded(added)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            known[new] = np.arange(self.n_words, self.n_words + len(new))
            self.begins = appended(self.begins, self.n_words, self.n_ids + np.cumsum(sizes) - sizes)
            self.sizes = appended(self.sizes, self.n_words, sizes)
            self.ids = appended(self.ids, self.n_ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())))
            short = [(w, k) for k, w in enumerate(added, self.n_words) if len(w) <= LONG_WORD]
            self.n_words, self.n_ids = self.n_words + len(new), self.n_ids + int(sizes.sum())
            self.memo.update(short)
            self.held += sum(len(w) for w, _ in short)
        return known

    def _encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.n_words > MAX_MEMO or self.held > MAX_MEMO_BYTES or self.n_ids > MAX_MEMO_BYTES:
            self.reset()
        cut = None
        if self.by_class and len(raw):
            data = raw.tobytes()
            if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:  # no special string, no mark that a capital letter would not join
                raw = _LOWER[raw]
            kinds = _classes(raw)
            cut = np.zeros(len(raw), bool)
            cut[1:] = _CUT[kinds[:-1] * 8 + kinds[1:]]
        words = Words(raw, bounds, _INSIDE[raw], cut)
        which, different = words.distinct()
        number = np.insert(self._numbers(different)[which], words.bounds[1:], 0)
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)[words.bounds[1:] + np.arange(len(bounds) - 1)]
        return self.ids[ragged(self.begins[number], sizes)], np.diff(ends, prepend=0)

    def __call__(self, texts: Texts | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with the end id after each, and how many ids each text has."""
        texts = as_texts(texts)
        if not self.by_word:
            found = [[*ids, END_ID] for ids in self._whole(texts.strings())]
            return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))
        if len(texts.raw) <= 2 * PART_BYTES or len(texts) > 1:
            return self._encode(texts.raw, texts.bounds)
        parts, at = [], 0
        while at < len(texts.raw):  # one long text, cut at spaces
            end = min(at + PART_BYTES, len(texts.raw))
            while end < len(texts.raw) and _INSIDE[texts.raw[end]]:
                end += 1
            ids, _ = self._encode(texts.raw[at:end], np.asarray([0, end - at]))
            parts.append(ids if end == len(texts.raw) else ids[:-1])
            at = end
        return np.concatenate(parts), np.asarray([sum(map(len, parts))])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None) -> Encoder:
    return resident(("encoder", path), lambda: Encoder(path or default_path()))


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, row_index_stride: int = 1000, bloom_fpp: float = 0.01) -> None:
    """Encode every text of ``df`` and write the dataset to ``path``.

    The texts are dealt out by range of (doc_id, hash of text) before they are
    encoded, so that the sampling for the ranges does not encode anything and one
    much repeated id is still split.
    """
    spark = df.sparkSession
    docs = two_columns(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    salted = docs.withColumn("salt", F.rand(7))  # rows that repeat id and text are alike, and may be dealt anywhere among themselves
    docs = salted.repartitionByRange("doc_id", "tie", "salt").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def encode(batches):
        run, shard, begun = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, texts in Texts(batch.column(1)).slices(PART_BYTES):
                ids, sizes = run(texts)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard), pa.int32()), batch.column(0).slice(a, b - a), pa.array(bounds[:-1] + begun), pa.array(sizes), tokens], names=["shard", "doc_id", "start_in_shard", "n_tokens", "tokens"])
                begun += int(bounds[-1])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.mapInArrow(encode, f"shard int, doc_id {kind}, start_in_shard long, n_tokens long, tokens array<int>")
    out.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp)).option("orc.row.index.stride", str(row_index_stride)).orc(f"{path}/tokens")
    sizes = spark.read.orc(f"{path}/tokens").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per range partition: small, whatever the number of documents in it.
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start")).coalesce(1).write.orc(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, tokens; ``doc_ids`` is pushed into the ORC reader, where row indexes and Bloom filters skip what cannot hold them."""
    rows = spark.read.orc(f"{path}/tokens")
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(list(doc_ids)))
    shards = spark.read.orc(f"{path}/shards")
    return rows.join(shards, "shard").select("doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "tokens")


def _digests(df: DataFrame) -> DataFrame:
    """Replace the ids by the crc32 of their bytes, before anything is shuffled."""
    keep = [c for c in df.columns if c != "tokens"]

    def run(batches):
        for batch in batches:
            ids = batch.column(len(keep))
            data = np.asarray(ids.flatten(), "<i4").tobytes()
            sizes = np.asarray(batch.column(keep.index("n_tokens")), np.int64)
            ends = np.cumsum(sizes) * 4
            crc = [zlib.crc32(data[e - 4 * n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    fields = ", ".join(f"{c} {t}" for c, t in df.select(*keep).dtypes)
    return df.select(*keep, "tokens").mapInArrow(run, f"{fields}, ids_crc32 long")


def token_file_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` to the file format, read the files back, and describe each document."""
    spark = df.sparkSession
    path = path or new_path(spark, "token-files")
    write_token_files(df, path, id_col, text_col, tokenizer)
    rows = _digests(spark.read.orc(f"{path}/tokens"))
    shards = spark.read.orc(f"{path}/shards")
    return rows.join(shards, "shard").select("doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
