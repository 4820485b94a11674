"""Token counts and token files against the tokenizers library."""

import os
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quillstone.llm import packing, token_counts, token_files
from quillstone.llm._shared import new_path
from tests.llm import cases

PARTS = [*"aab's't're ve 'll  \n\n\t\r'd!?123é日本　\xa0\x85\x1c\x0b𝔸ñ'LL'S", "<|endoftext|>", "<|startoftext|>", " the", "ing", "'s", "   ", "é", "́", "İ", "Σ", "ς"]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(1, 150))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(P.path(name))


def test_counts_equal_the_library():
    rows = [t for _, t in cases.ROWS] + texts() + ["a" * 5000, " " * 3000, "-" * 3000, "ab" * 3000, "'", "''s", " 's", "a "]
    want = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch([t or "" for t in rows], add_special_tokens=False)]
    assert token_counts.Counter(token_counts.default_path())(rows).tolist() == want


def test_chunk_maps_compose():
    points = np.array([ord(c) for c in "".join(texts(40))], np.int32)
    whole = token_counts.piece_starts(points, len(points))
    for chunk in (1, 2, 7, 64, 1000):
        assert (token_counts.piece_starts(points, chunk) == whole).all()


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 40)
    rows = texts(60, 7) + ["the cat's don't sit " * 200, "a b" * 500, None]
    want = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch([t or "" for t in rows], add_special_tokens=False)]
    assert token_counts.Counter(token_counts.default_path())(rows).tolist() == want


def test_what_is_remembered_may_be_dropped(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_PAIRS", 50)
    monkeypatch.setattr(token_counts, "MAX_MEMO", 20)
    rows = texts(30, 5)
    want = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(rows, add_special_tokens=False)]
    assert token_counts.Counter(token_counts.default_path())(rows).tolist() == want


def test_one_run_of_a_megabyte():
    """In a process whose memory is bounded: a run of n bytes once stored n * n / 2 of them."""
    rng = random.Random(3)
    runs = ["".join(rng.choices("ACGT", k=1 << 20)), "-=" * (1 << 16), "日本語" * 20000, "7" * 50001]
    code = "import resource, sys; resource.setrlimit(resource.RLIMIT_AS, (3 << 30, 3 << 30)); from quillstone.llm import token_counts as t; print(*t.Counter(t.default_path())(sys.stdin.read().split()))"
    got = subprocess.run([sys.executable, "-c", code], input=" ".join(runs), capture_output=True, text=True, env=os.environ | {"OPENBLAS_NUM_THREADS": "1"}, timeout=300)
    want = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(runs, add_special_tokens=False)]
    assert (got.stdout.split(), got.returncode) == ([str(n) for n in want], 0), got.stderr[-2000:]


def test_what_is_kept_is_bounded(monkeypatch):
    rows = ["".join(random.Random(k).choices("abcdé", k=n)) for k, n in enumerate([255, 256, 257, 300, 2000, *range(1, 200)])]
    want = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(rows, add_special_tokens=False)]
    monkeypatch.setattr(token_counts, "MAX_MEMO_BYTES", 1000)
    monkeypatch.setattr(token_counts, "MAX_PAIRS", 100)
    run = token_counts.Counter(token_counts.default_path())
    assert run(rows).tolist() == want == run(rows).tolist()
    held = run.remembered
    assert max(sum(map(len, held.memo)), sum(map(len, held.old))) <= 1000 and max(map(len, held.memo | held.old)) <= 256
    assert run.pieces.pairs.used <= 100


def test_counts_query(spark):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(cases.frame(spark)).collect())
    t = library("byte_bpe_50k.json")
    want = sorted((i or 0, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in cases.ROWS)
    assert got == want
    assert token_counts.token_counts(cases.empty(spark)).count() == 0


def test_encoder_equals_the_library(monkeypatch):
    rows = [t for _, t in cases.ROWS] + texts(300, 2)
    run = token_files.Encoder(token_files.default_path())
    assert run.by_word
    want = [[*e.ids, 1] for e in library("word_bpe_49k.json").encode_batch([t or "" for t in rows], add_special_tokens=False)]
    ids, sizes = run(rows)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    monkeypatch.setattr(token_files, "MAX_MEMO", 30)
    monkeypatch.setattr(token_files, "PART_BYTES", 50)
    for text, x in zip(rows, want, strict=True):  # one by one, long ones in parts, and the memo dropped again and again
        assert run([text])[0].tolist() == x


def test_files_round_trip(spark):
    path = new_path(spark, "round-trip")
    token_files.write_token_files(cases.frame(spark), path)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    t = library("word_bpe_49k.json")
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in cases.ROWS)
    assert sorted(r.tokens for r in rows) == want
    assert [r.doc_id for r in token_files.read_token_files(spark, path, [5]).collect()] == [5]


def test_digests(spark):
    t = library("word_bpe_49k.json")
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_file_digests(cases.frame(spark)).collect()}
    want = {(i, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())) for i, x in cases.ROWS for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 1]]}
    assert got == want
    assert token_files.token_file_digests(cases.empty(spark)).count() == 0


def least_padding(lengths, counts, k):
    """All choices of boundaries."""
    from itertools import combinations

    best = None
    for inner in combinations(lengths[:-1], min(k, len(lengths)) - 1):
        bounds = [*inner, lengths[-1]]
        cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), 9))
    counts = [rng.randint(1, 30) for _ in lengths]
    for k in (1, 2, 3, 4, 20):
        bounds = packing.best_boundaries(np.array(lengths), np.array(counts), k)
        cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
        assert len(bounds) <= k and cost == least_padding(lengths, counts, k)


def test_packing_is_whole(spark):
    rows = packing.pack(cases.frame(spark), max_len=512, buckets=3, budget=2048, shard_rows=2).collect()
    t = library("byte_bpe_50k.json")
    want = sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in cases.ROWS)
    sums = {}
    for r in rows:
        sums.setdefault(r.doc_id, []).append(r.n_tokens)
        assert 1 <= r.n_tokens <= r.bucket_len <= 512 and 0 <= r.slot < 2048 // r.bucket_len
    assert sum(map(sum, sums.values())) == sum(want)
    assert len({(r.batch_id, r.slot) for r in rows}) == len(rows)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append((r.slot, r.bucket_len))
    assert sorted(batches) == list(range(len(batches)))
    for at, found in batches.items():
        assert sorted(s for s, _ in found) == list(range(len(found))) and len({b for _, b in found}) == 1
    for b in {r.bucket_len for r in rows}:  # only a bucket's last batch may be short
        full = [len(v) for k, v in sorted(batches.items()) if v[0][1] == b]
        assert all(n == 2048 // b for n in full[:-1])
    by_id = {}
    for r in rows:
        by_id.setdefault((r.doc_id, r.piece), []).append((r.start, r.n_tokens))
    assert all(start == 512 * piece for (_, piece), found in by_id.items() for start, _ in found)
    # the buckets are the best ones of all the pieces' lengths, and each piece is in the smallest that holds it
    lengths = [n for x in want for n in [512] * ((x - 1) // 512) + [(x - 1) % 512 + 1]]
    assert sorted(r.n_tokens for r in rows) == sorted(lengths)
    different = sorted(set(lengths))
    bounds = sorted({r.bucket_len for r in rows})
    assert all(r.bucket_len == min(b for b in bounds if b >= r.n_tokens) for r in rows)
    assert sum(r.bucket_len - r.n_tokens for r in rows) == least_padding(different, [lengths.count(x) for x in different], 3)
    assert packing.pack(cases.empty(spark)).count() == 0


def test_packing_splits_rows_without_an_id(spark):
    """Many rows without an id, and many that repeat one, spread over the shards."""
    lengths = spark.createDataFrame([(None if k % 2 else 5, 7) for k in range(3000)], "doc_id long, n long")
    out = packing.pack_lengths(lengths, max_len=16, buckets=2, budget=64, shard_rows=100)
    assert out.select("batch_id", "slot").distinct().count() == 3000
    found = {r.batch_id: r for r in out.groupBy("batch_id").agg({"doc_id": "count", "slot": "count"}).collect()}
    mixed = sum(0 < r["count(doc_id)"] < r["count(slot)"] for r in found.values())
    assert mixed > len(found) / 2


def test_orc_metadata_lets_a_reader_skip(spark):
    """The files hold row indexes and Bloom filters, and a lookup reads less than the whole."""
    from pyspark.sql import functions as F

    path = new_path(spark, "orc-metadata")
    docs = spark.range(0, 40_000, 2).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    token_files.write_token_files(docs.coalesce(1), path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/tokens")
    names = [s.getPath() for s in folder.getFileSystem(conf).listStatus(folder) if s.getPath().getName().endswith(".orc")]
    kinds, strides = set(), set()
    for name in names:
        reader = jvm.org.apache.orc.OrcFile.createReader(name, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        strides.add(reader.getRowIndexStride())
        rows = reader.rows()
        for stripe in reader.getStripes():
            kinds |= {s.getKind().toString() for s in rows.readStripeFooter(stripe).getStreamsList()}
    assert strides == {1000} and "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)

    def rows_read(ids):
        found = token_files.read_token_files(spark, path, ids)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        import re

        text = plan.toString()
        assert re.search(r"PushedFilters: \[[^\]]*doc_id", text), text
        scans, todo = [], [plan]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(k) for k in range(node.children().size())]
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
            elif node.nodeName().endswith("QueryStage"):
                todo.append(node.plan())
            if node.nodeName().startswith("Scan orc") and "n_tokens" in node.toString():
                scans.append(node.metrics().apply("numOutputRows").value())
        return found.count(), max(scans)

    there, read = rows_read([6 * 1234])
    assert there == 1 and read <= 5000  # of 20,000: only row groups that may hold the id
    absent, read = rows_read([6 * 1234 + 1])  # inside the range of a row group, but the Bloom filter knows better
    assert absent == 0 and read == 0
