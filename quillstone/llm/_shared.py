"""Plumbing shared by the operators: staging tables, Arrow passes, words as numpy ranges."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handled in Python in slices of about this many UTF-8 bytes, so that
#: the arrays of a slice stay small whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, the session's
    own checkpoint folder is used; a temporary one is made only for a local master.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillstone/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new place below the application's folder in the shared one."""
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Delete every table that this application staged; results not yet read are lost with them."""
    _delete(spark, _application_dir(spark))


class Stage:
    """Tables of one operator: written in the shared folder as Parquet and read again.

    This cuts the lineage, outlives lost executors, and later reads prune columns.
    ``done`` deletes all but the tables that the result still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, self.paths.pop(id(df))[0])

    def done(self, *needed: DataFrame) -> None:
        self.drop(*[df for _, df in list(self.paths.values()) if not any(df is n for n in needed)])


def staged(df: DataFrame, name: str) -> DataFrame:
    """One table by itself, see ``Stage``."""
    return Stage(df.sparkSession)(df, name)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, so that no other column can clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


MARK_BITS = 1 << 24


def marked(df: DataFrame, key: str, ids: DataFrame, bits: int = MARK_BITS) -> DataFrame:
    """``df`` with ``maybe``: true for every row whose key is among ``ids`` (one column of that name), and for few others.

    What is broadcast is a bitmap of ``bits`` bits in words of 64, so at most
    ``bits`` / 64 rows whatever the number of ids; the fuller it is, the more others
    pass.  A join that has to move rows need only move those.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    word = F.floor(place / 64).cast("long")
    words = ids.select(word.alias("mark_word"), one.alias("bit")).groupBy("mark_word").agg(F.bit_or("bit").alias("mark_bits"))
    out = df.withColumn("mark_word", word).withColumn("mark_bit", one).join(F.broadcast(words), "mark_word", "left")
    return out.withColumn("maybe", F.coalesce(F.col("mark_bits").bitwiseAND(F.col("mark_bit")) != 0, F.lit(False))).drop("mark_word", "mark_bit", "mark_bits")


class Texts:
    """Some rows of a string column; a null is the empty text."""

    def __init__(self, column: pa.Array):
        self.column = column.fill_null("") if column.null_count else column
        _, offsets, data = self.column.buffers()
        n, at = len(self.column), self.column.offset
        if offsets is None or not n:
            self.bounds, self.raw = np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
            return
        wide = pa.types.is_large_string(self.column.type)
        bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
        #: The UTF-8 bytes, and where in them each text begins and the last one ends.
        self.raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]

    def __len__(self) -> int:
        return len(self.column)

    def strings(self) -> list[str]:
        return self.column.to_pylist()

    def slices(self, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
        """Ranges of rows whose texts together hold about ``limit`` bytes."""
        begin = 0
        while begin < len(self):
            end = max(begin + 1, int(np.searchsorted(self.bounds, self.bounds[begin] + limit, "right")) - 1)
            yield begin, end, Texts(self.column.slice(begin, end - begin))
            begin = end


def as_texts(rows: Texts | list[str | None]) -> Texts:
    return rows if isinstance(rows, Texts) else Texts(pa.array(rows, pa.string()))


class Words:
    """The words of a slice of texts: stretches of bytes inside which a flag is set, cut where ``cut`` is set besides."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, inside: np.ndarray, cut: np.ndarray | None = None):
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        joined = bounds[:-1][bounds[:-1] < len(raw)]  # a word that touches the text before begins all the same
        begin[joined] = inside[joined]
        if cut is not None:
            begin |= cut
        self.begins = np.flatnonzero(begin)
        #: The place of each text's first word among all words, and their number at the end.
        self.bounds = np.searchsorted(self.begins, bounds)
        self._kept = raw[inside]
        self.sizes = np.diff(np.cumsum(inside, dtype=np.int64)[self.begins] - 1, append=len(self._kept))

    def __len__(self) -> int:
        return len(self.begins)

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        return distinct(self._kept, self.sizes)


def distinct(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of strings that stand one after the other in ``data``: the number of each among the different ones, and these."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


class Memo:
    """Whole numbers from 0 on, of byte strings, in two bounded generations: what is still in use outlives a change of generation."""

    def __init__(self, entries: int, size: int, longest: int):
        self.entries, self.size, self.longest = entries, size, longest
        self.memo: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.held = 0  # bytes of the strings in memo

    def __call__(self, words: list[bytes], make: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
        """The numbers of some different strings; ``make`` gives those that are not known."""
        found = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        some = [words[k] for k in missing.tolist()]
        again = np.fromiter(map(self.old.get, some, repeat(-1)), np.int64, len(some))
        new = np.flatnonzero(again < 0)
        if len(new):
            again[new] = make([some[k] for k in new.tolist()])
        found[missing] = again
        for w, n in zip(some, again.tolist(), strict=True):
            if len(w) <= self.longest:
                if len(self.memo) >= self.entries or self.held + len(w) > self.size:
                    self.old, self.memo, self.held = self.memo, {}, 0
                self.memo[w] = n
                self.held += len(w)
        return found


class IntMap:
    """Whole numbers by whole numbers from 0 on: open addressing, many keys at a time."""

    def __init__(self, entries: int):
        self.bits = max(4, (2 * entries).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys that are not held yet."""
        at, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = keys[free]  # of several for one slot, one gets it
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.used += len(keys)


class Trie:
    """Which of some different byte strings stand where in other bytes."""

    def __init__(self, strings: list[bytes]):
        nodes = {b"": 0}
        for x in strings:
            for k in range(1, len(x) + 1):
                nodes.setdefault(x[:k], len(nodes))
        del nodes[b""]
        keys = np.fromiter((nodes.get(x[:-1], 0) << 8 | x[-1] for x in nodes), np.int64, len(nodes))
        self.children = IntMap(len(nodes))
        self.children.put(keys, np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.string_at = np.full(len(nodes) + 1, -1, np.int32)
        self.string_at[np.fromiter((nodes[x] for x in strings), np.int64, len(strings))] = np.arange(len(strings))

    def arcs(self, data: np.ndarray, ends: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and number of every string in ``data`` that begins at one of ``at`` (everywhere) and does not pass the end given there."""
        at = np.arange(len(data)) if at is None else at
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        node, size = np.zeros(len(at), np.int64), 0
        while len(at):
            node = self.children.get(node << 8 | data[at + size]).astype(np.int64)
            alive = node >= 0
            at, node, size = at[alive], node[alive], size + 1
            string = self.string_at[node]
            has = string >= 0
            found.append((at[has], np.full(int(has.sum()), size), string[has]))
            inside = at + size < ends[at]
            at, node = at[inside], node[inside]
        begin, length, string = (np.concatenate(x) for x in zip(*found, strict=True))
        return begin, length, string


def appended(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``held``, of which ``used`` entries count, with ``new`` after these; the room doubles when it is too small."""
    if used + len(new) > len(held):
        held = np.concatenate([held[:used], np.zeros(max(used, len(new), 1024), held.dtype), np.zeros(len(new), held.dtype)])
    held[used : used + len(new)] = new
    return held


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every range, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


def with_columns_from(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[Texts], list[pa.Array]]],
    keep_text: bool = True,
) -> DataFrame:
    """Add columns computed in Python from one text column, in one narrow pass.

    ``make`` runs once per task and returns a function from some texts to one Arrow
    array per field.  An input column named like a new field (in any case) is
    replaced.  Every other column passes through unchanged; the text does not come
    back from Python unless ``keep_text``.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new]
    if text_col not in keep:
        raise ValueError(f"the text column {text_col!r} has the name of a result column")
    base = df.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text_col)
    back = [k for k in range(len(keep)) if keep_text or k != at]
    schema = T.StructType([*[base.schema.fields[k] for k in back], *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for a, b, texts in Texts(batch.column(at)).slices():
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in back], *work(texts)], names=names)
        del work
        give_back()

    return base.mapInArrow(run, schema)


class Keyed:
    """A broadcast that a cache can key on."""

    def __init__(self, broadcast):
        self.broadcast, self.key = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


_RESIDENT: dict = {}


def resident(key, make: Callable):
    """What ``make`` gives, kept in the worker process for its next tasks until another is asked for.

    A process serves the stages of many operators; it holds the tables and memos of one.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        give_back()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def give_back() -> None:
    """Return memory that is free to the system, which else stays with the process while others need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
