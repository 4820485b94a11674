"""Near-duplicate components by min-max hashing and exact confirmation.

A document's set holds the distinct shingles of ``SHINGLE`` words (fewer words: the
whole sequence; none: empty).  Per permutation both the minimum and the maximum are
kept, so ``PERMUTATIONS`` hash evaluations give twice as many signature values, which
are banded by ``ROWS``.  Two documents are linked when their full sets reach the
threshold; components join links.

How it stays linear in the size of a group, without losing a link:

1. Documents with equal sets form a class, which its smallest id represents.
2. Representatives that share a band meet in a bucket.  Each is compared with one
   member of the bucket, the one whose buckets are the largest (of a group of near
   copies, the text that they were made from), so there is one candidate per member
   and bucket; full sets decide.
3. Components of these links.  In buckets that still hold several components, the
   other pairs of different components are tried: the bucket is cut into blocks, the
   members of its most frequent component apart from the others, and block pairs are
   dealt out over tasks, except pairs of that component's blocks.  A pair of members
   is passed on only if it passes an exact bound and this is the first band that they
   share.  The bound: each set has two bitmaps of ``PARITY`` bits, of which each item
   flips one, so two bitmaps differ in no more bits than their sets differ in items;
   one matrix product gives the differences of a whole block pair in the first, and
   what passes is held against the second.  Near misses end there, without a row.  Full sets decide again, and the components are joined once
   more.  A bucket whose members are all near misses of each other still takes the
   square of its size, in operations of a few nanoseconds.
4. A set that many pairs need is copied to as many numbered places as it takes to
   have at most ``FAN`` pairs in each.

Shingles are 64-bit hashes; classes are told apart by 128 bits.  With 24 bands of 4
values, a pair right at 0.85 shares no band with probability 2e-8, at 0.8 with 3e-6.

Edge cases: null and empty texts have an empty set and link with nothing; a null id
links with nothing, has a null component and is kept; rows that share an id stand for
one document, and what links one of them links all; texts of any length are read
whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import SLICE_BYTES, Stage, marked, mix64, resident, two_columns, with_columns_from

SHINGLE, PERMUTATIONS, ROWS, PARITY = 5, 48, 4, 2048
#: Members of a block (a bucket is cut into about 8 blocks, within these limits), and pairs of one set in one place.
LEAST_BLOCK, BLOCK, FAN = 128, 1024, 256
BANDS = 2 * PERMUTATIONS // ROWS

_BASE = 0x100000001B3 * 2 + 1  # odd, so that it has an inverse modulo 2**64
_POWER: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            _POWER[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWER["up"], _POWER["down"]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of at most a slice of bytes, and where the words begin."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one text of any length, piece by piece, cut at white space."""
    if len(data) <= SLICE_BYTES:
        return _hash_words(data)[0]
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        parts.append(_hash_words(data[at:end])[0])
        at = end
    return np.concatenate(parts)


_WEIGHTS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    m = min(size, n)
    total = np.full(n - m + 1, m, np.uint64)
    for j in range(m):
        total += words[j : n - m + 1 + j] * _WEIGHTS[j]
    return np.unique(mix64(total))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data = [(t or "").encode().lower() for t in texts]  # bytes.lower() changes A-Z alone
    if sum(map(len, data)) > 2 * SLICE_BYTES:
        return [_shingles(word_hashes(d), size) for d in data]
    words, begin = _hash_words(b" ".join(data))
    bounds = np.searchsorted(begin, np.cumsum([0, *[len(d) + 1 for d in data]]))
    return [_shingles(words[a:b], size) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minima, then maxima, of each set under each permutation: (sets, 2 * permutations) uint32; all sets hold something."""
    values = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), 2 * permutations), np.uint32)
    salts = mix64(np.arange(1000, 1000 + 2 * permutations, dtype=np.uint64))
    for k in range(permutations):
        hashed = (values ^ salts[2 * k]) * (salts[2 * k + 1] | np.uint64(1))
        out[:, k] = np.minimum.reduceat(hashed, at) >> np.uint64(32)
        out[:, permutations + k] = np.maximum.reduceat(hashed, at) >> np.uint64(32)
    return out


def bands_of(signs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band, different for equal values in different bands."""
    n = signs.shape[1] // rows
    parts = signs.reshape(len(signs), n, rows).astype(np.uint64)
    key = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(signs), 1))
    for j in range(rows):
        key = mix64(key + parts[:, :, j] * _WEIGHTS[j])
    return key


def parities(sets: list[np.ndarray], bits: int = PARITY) -> np.ndarray:
    """Two bitmaps per set, of each of which each item flips one bit: (sets, 2 * bits / 8) bytes."""
    if len(sets) > 512:
        return np.concatenate([parities(sets[k : k + 512], bits) for k in range(0, len(sets), 512)])
    owner, items = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    both = []
    for shift in (40, 8):
        place = (items >> np.uint64(shift)) % np.uint64(bits)
        counts = np.bincount(owner * bits + place.astype(np.int64), minlength=len(sets) * bits)
        both.append(np.packbits((counts & 1).astype(np.uint8).reshape(len(sets), bits), axis=1))
    return np.concatenate(both, axis=1)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    fields = [T.StructField(c, t) for c, t in (("n_shingles", T.LongType()), ("k1", T.LongType()), ("k2", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("parity", T.BinaryType()))]

    def make():
        resident("shingles", dict)  # nothing is kept, and nothing of another operator

        def work(texts):
            sets = shingle_sets(texts.strings(), size)
            sizes = np.asarray([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            k1, k2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            bands, bits = [[]] * len(sets), [b""] * len(sets)
            if full:
                at = np.cumsum([0, *map(len, full)])[:-1]
                values, has = np.concatenate(full), np.flatnonzero(sizes)
                k1[has] = np.add.reduceat(mix64(values + np.uint64(1)), at)
                k2[has] = np.add.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), at)
                keys, flips = bands_of(signatures(full)).view(np.int64), parities(full)
                for j, row in enumerate(has.tolist()):
                    bands[row], bits[row] = keys[j], flips[j].tobytes()
            return [pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())]

        return work

    return with_columns_from(docs, "text", fields, make, keep_text=False)


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The sets of the documents in ``ids``, made anew from their texts; few other texts are moved for it."""

    def make():
        return lambda texts: [pa.array([s.view(np.int64) for s in shingle_sets(texts.strings(), size)], pa.list_(pa.int64()))]

    found = marked(docs, "doc_id", ids).filter("maybe").select(*docs.columns).join(ids, "doc_id", "left_semi")
    return with_columns_from(found, "text", [T.StructField("items", T.ArrayType(T.LongType()))], make, keep_text=False)


def _with_set(pairs: DataFrame, sets: DataFrame, key: str, uses: DataFrame | None = None) -> DataFrame:
    """Add the set of ``key``, as ``set_<key>``.

    A set of many pairs goes to several places.  ``uses`` bounds its pairs (key, uses),
    and then ``pairs`` has a column ``uses`` that is not above that; else they are counted.
    """
    if uses is None:
        uses = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
        pairs = pairs.join(uses, key)
    places = F.ceil(F.col("uses") / FAN).cast("int")
    dealt = pairs.withColumn("place", F.pmod(F.xxhash64("u", "v"), places)).drop("uses")
    copies = sets.withColumnRenamed("doc_id", key).join(uses, key).select(key, F.col("items").alias(f"set_{key}"), F.explode(F.sequence(F.lit(0).cast("long"), places.cast("long") - 1)).alias("place"))
    return dealt.join(copies, [key, "place"]).drop("place")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int, uses: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold; ``uses`` bounds the pairs of a v."""
    if uses is None:
        both = _with_set(_with_set(pairs.select("u", "v"), sets, "u"), sets, "v")
    else:
        both = _with_set(pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("items").alias("set_u")), "u"), sets, "v", uses)
    found = both.select("u", "v", F.size(F.array_intersect("set_u", "set_v")).alias("both"), (F.size("set_u") + F.size("set_v")).alias("sum"))
    return found.filter(F.col("both") * 100 >= percent * (F.col("sum") - F.col("both"))).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for the nodes of ``links`` (u, v) that are not their own label.

    Links point from the larger to the smaller node.  First, while some node has
    several smaller neighbours, its smallest is kept and the others are linked to
    that one; then parents are replaced by their parents until nothing changes.  A
    node with very many larger neighbours never has them gathered.
    """
    stage = Stage(links.sparkSession)
    tree = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    while tree.groupBy("u").count().filter("count > 1").limit(1).count():
        low = tree.groupBy("u").agg(F.min("v").alias("m"))
        rest = tree.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = stage(low.select("u", F.col("m").alias("v")).union(rest).distinct(), "links")
        stage.done(tree)
    while True:
        up = tree.select(F.col("u").alias("v"), F.col("v").alias("w"))
        if not tree.join(up, "v", "left_semi").limit(1).count():
            return tree.select(F.col("u").alias("node"), F.col("v").alias("label"))
        tree = stage(tree.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v")), "links")
        stage.done(tree)


class _Maps:
    """Bitmaps and sizes of some sets."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.first = np.unpackbits(bits[:, : PARITY // 8], axis=1).astype(np.float32) * 2 - 1
        self.second = np.ascontiguousarray(bits[:, PARITY // 8 :]).view(np.uint64)
        self.sizes = sizes

    def close(self, a: int, b: int, other: "_Maps", allowed: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sets a to b - 1 and which of the others, among the allowed pairs, may reach the threshold together."""
        n, m = self.sizes[a:b, None], other.sizes[None, :]
        most = (100 - percent) * (n + m) // (100 + percent)  # items that the two may differ in
        flips = (PARITY - self.first[a:b] @ other.first.T) / 2
        i, j = np.nonzero((np.maximum(flips, np.abs(n - m)) <= most) & allowed)
        fits = np.bitwise_count(self.second[a + i] ^ other.second[j]).sum(1, dtype=np.int64) <= most[i, j]
        return a + i[fits], j[fits]


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) inside block pairs whose labels differ and whose bitmaps allow a link.

    Blocks 0 to ``minor`` - 1 hold the members that are not ``common`` (of the bucket's
    most frequent label), the others those that are, which do not meet each other.
    """
    size = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(BLOCK), F.floor(F.col("m") / 8)))
    minor, major = F.ceil((F.col("m") - F.col("n_common")) / size).cast("int"), F.ceil(F.col("n_common") / size).cast("int")
    h = F.xxhash64("node")
    block = F.when(F.col("common"), minor + F.pmod(h, major)).otherwise(F.pmod(h, minor)).cast("int")
    partners = F.when(F.col("common"), F.sequence(F.lit(0), minor - 1)).otherwise(F.sequence(F.lit(0), minor + major - 1))
    dealt = rows.select("*", block.alias("b"), F.explode(partners).alias("j"))
    dealt = dealt.select("band", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi"), "no", "b", "node", "label", "n_shingles", "bands", "parity")
    dealt = dealt.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")

    def pairs(group: pa.Table):
        lo, hi, no = (group.column(c)[0].as_py() for c in ("lo", "hi", "no"))
        b, node, label, n = (group.column(c).to_numpy() for c in ("b", "node", "label", "n_shingles"))
        keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(b), BANDS)
        bits = np.frombuffer(b"".join(group.column("parity").to_pylist()), np.uint8).reshape(len(b), PARITY // 4)
        one, two = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        left, right = _Maps(bits[one], n[one]), _Maps(bits[two], n[two])
        us, vs = [], []
        for at in range(0, len(one), 64):
            some = one[at : at + 64]
            allowed = label[some][:, None] != label[two]
            if lo == hi:
                allowed &= some[:, None] < two
            i, j = left.close(at, at + len(some), right, allowed, percent)
            i, j = one[i], two[j]
            first = (keys[i] == keys[j]).argmax(1) == no
            us.append(node[i[first]])
            vs.append(node[j[first]])
        return np.concatenate([*us, np.zeros(0, np.int64)]), np.concatenate([*vs, np.zeros(0, np.int64)])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held.column(c).to_numpy() for c in ("band", "lo", "hi")], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, z in zip([0, *cut[:-1]], cut, strict=False):
                us, vs = pairs(held.slice(a, z - a))
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
            if len(cut):
                held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            us, vs = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row.  Ids are whole numbers."""
    stage = Stage(df.sparkSession)
    docs = two_columns(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sigs = stage(_signed(docs, shingle), "signatures")
    alive = sigs.filter("doc_id is not null and n_shingles > 0")
    classes = stage(alive.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = alive.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    members = reps.select(F.col("doc_id").alias("node"), F.posexplode("bands").alias("no", "band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = stage(members.join(sizes, "band"), "shared-bands")
    weight = shared.groupBy("node").agg(F.sum("m").alias("weight"))  # what many resemble is in the largest buckets
    buckets = shared.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    buckets = stage(buckets.select("band", (-F.col("top.minus")).alias("pivot")), "buckets")
    met = stage(shared.join(buckets, "band").filter("node <> pivot"), "bucket-members")
    tried = met.groupBy(F.col("node").alias("u"), F.col("pivot").alias("v")).agg(F.max("m").alias("uses"))
    uses = met.groupBy(F.col("pivot").alias("v")).agg(F.max("m").alias("uses"))
    wanted = stage(met.select(F.explode(F.array("node", "pivot")).alias("doc_id")).distinct(), "wanted")
    sets = stage(_full_sets(docs, wanted, shingle), "shingle-sets")
    labels = components(stage(_confirmed(sets, tried, percent, uses), "links"))

    # Buckets in which members beside the smallest are in different components.
    named = met.filter("m > 2").join(labels, "node", "left").select("band", "no", "node", F.coalesce("label", "node").alias("label"))
    named = stage(named, "bucket-labels")
    sizes = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("band").agg(F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("top")).filter("top.n < m")
    open_ = stage(open_.select("band", "m", F.col("top.n").alias("n_common"), F.col("top.label").alias("most")), "open-buckets")
    rest = named.join(open_, "band").withColumn("common", F.col("label") == F.col("most"))
    signs = sigs.select(F.col("doc_id").alias("node"), "n_shingles", "bands", "parity")
    second = stage(_block_pairs(rest.join(signs, "node"), percent), "pairs")
    second = stage(_confirmed(sets, second, percent), "links")
    if second.limit(1).count():
        a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "uv")
        bridges = second.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        again = components(bridges)
        moved = labels.join(again.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
        labels = stage(moved.union(again.join(labels, "node", "left_anti").select("node", "label")), "labels")

    named = classes.join(labels, classes.rep == labels.node, "left").select("k1", "k2", F.coalesce("label", "rep").alias("component"), "copies", "rep")
    named = stage(named.filter("copies > 1 or component <> rep").select("k1", "k2", "component"), "class-components")
    stage.done(sigs, named)
    out = sigs.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``df``, all columns, without those whose document is not the smallest of its component.

    Only rows that a bitmap of the ids to drop marks are moved to be held against these ids.
    """
    found = near_components(df, id_col, text_col, percent, shingle)
    gone = Stage(df.sparkSession)(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    rows = marked(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id")), "doc_id", gone)
    sure, rest = rows.filter("not maybe").select("row"), rows.filter("maybe").join(gone, "doc_id", "left_anti").select("row")
    return sure.union(rest).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
