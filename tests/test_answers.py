"""Golden and property tests of settled answers, sessions, state and storage."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import answers, catalog, sessions, state, storage

T0 = dt.datetime(2024, 1, 1)


def polls(spark, streams):
    """streams: per key the texts in order; None is a placeholder poll."""
    rows = [(k, T0 + dt.timedelta(seconds=i), i, t, t is None) for k, texts in enumerate(streams) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, text string, thinking boolean")


def settled(spark, streams, k, previous=None):
    out = answers.stable(answers.usable(polls(spark, streams), None if previous is None else F.lit(previous)), k)
    found = {r.key: (r.seq, r.text) for r in out.collect()}
    return [found.get(i) for i in range(len(streams))]


def by_hand(texts, k):
    last, n = None, 0
    for i, t in enumerate(texts):
        if t is None or not t.strip():
            continue
        n = n + 1 if t.strip() == last else 1
        last = t.strip()
        if n >= k:
            return i, last
    return None


def test_stable_cases(spark):
    assert settled(spark, [list("AAA"), list("AAAA"), list("AABAAAA"), ["A", "A", None, "A", "A"], ["A", " ", "A\t", "A", "A "]], 4) == [None, (3, "A"), (6, "A"), (4, "A"), (4, "A")]
    assert settled(spark, [list("AA"), list("AAA")], 3) == [None, (2, "A")]
    assert settled(spark, [list("PPPNNN")], 3, " P") == [(5, "N")]


def test_two_selectors(spark):
    assert settled(spark, [list("AAAA"), list("ABABABAB")], 4) == [(3, "A"), None]


def test_stable_like_a_state_machine(spark):
    rng = random.Random(3)
    streams = [[rng.choice(["A", "A", "B", None, ""]) for _ in range(15)] for _ in range(200)]
    for k in (3, 4):
        assert settled(spark, streams, k) == [by_hand(s, k) for s in streams]


def test_latest_skips_placeholders(spark):
    assert answers.latest(polls(spark, [["A", "AB", None, " "]])).first().text == "AB"


def test_pairs(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (2, 0, "user", "q"), (2, 1, "user", "q'")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.answer, r.status) for r in answers.pairs(rows).collect()}
    assert got == {(1, 1): ("a1", "success"), (1, 3): (None, "error"), (2, 0): (None, "error"), (2, 1): (None, "error")}


def test_targets(spark):
    books = spark.createDataFrame([("a", "ua"), ("b", "ub")], "id string, url string")
    requests = spark.createDataFrame([(1, "given", "a"), (2, None, "a"), (3, None, "zz"), (4, None, None), (5, "", "")], "request_id long, url string, notebook_id string")
    for active, last in (("b", ("ub", "active")), ("gone", (None, "none"))):
        got = {r.request_id: (r.target, r.status) for r in answers.resolve_targets(requests, books, spark.createDataFrame([(active,)], catalog.STATE)).collect()}
        assert got == {1: ("given", "url"), 2: ("ua", "id"), 3: (None, "unknown id"), 4: last, 5: last}


def test_session_boundary(spark):
    rows = [(1, T0, 0), (1, T0 + dt.timedelta(seconds=900), 1), (2, T0, 0), (2, T0 + dt.timedelta(seconds=900, microseconds=1), 1)]
    ev = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long")
    assert sorted((r.key, r.message_count) for r in sessions.windows(ev).collect()) == [(1, 2), (2, 1), (2, 1)]
    assert sorted((r.key, r.session_no) for r in sessions.numbered(ev).collect()) == [(1, 0), (1, 0), (2, 0), (2, 1)]
    info = sessions.info(ev.filter("seq = 0"), "2024-01-01 00:15:00")
    assert [r.expired for r in sessions.expired(info, "2024-01-01 00:15:00").collect()] == [False, False]
    assert [r.expired for r in sessions.expired(info, "2024-01-01 00:15:00.000001").collect()] == [True, True]


def test_reset(spark):
    ev = polls(spark, [["m", "m", "reset", "m"]])
    got = {r.epoch: r.message_count for r in sessions.epochs(ev, F.col("text") == "reset").collect()}
    assert got == {0: 2, 1: 1}


@pytest.mark.parametrize(("days", "want"), [(7.0, "ok"), (7.1, "stale"), (None, "missing")])
def test_age(spark, days, want):
    at = None if days is None else dt.datetime(2024, 1, 31) - dt.timedelta(days=days)
    df = spark.createDataFrame([(at,)], "modified_at timestamp_ntz")
    row = state.age(df, "2024-01-31 00:00:00").first()
    assert row.status == want and row.authenticated == (days is not None)


def test_overlay(spark):
    df = spark.sql("SELECT map('authenticated', 'yes', 'x', '1') AS c, map('authenticated', 'no', 'y', '2') AS s")
    assert df.select(state.overlay_maps(F.col("c"), F.col("s")).alias("m")).first().m == {"authenticated": "no", "x": "1", "y": "2"}


def test_storage(spark):
    files = spark.createDataFrame([("browser_state/a/x", 10), ("browser_state/a/y", 5), ("browser_state/b", 1), ("library.json", 7), ("misc/deep/z", 2), ("misc/w", 3), ("note", 4)], "path string, size long")
    items = storage.items(files)
    assert {(r.category, r.path, r.type, r.size) for r in items.collect()} == {("browser_state", "browser_state/a", "dir", 15), ("browser_state", "browser_state/b", "file", 1), ("library", "library.json", "file", 7), ("other", "misc", "dir", 5), ("other", "note", "file", 4)}
    assert tuple(storage.total(items).first()) == (5, 32)
    assert tuple(storage.dry_run(storage.preserving(items, True)).first()) == (True, 4, 25)
    assert storage.dir_size(files, "misc").first()[0] == 5
    assert tuple(storage.total(items.limit(0)).first()) == (0, 0)
    assert {r.title for r in storage.preview(items).collect()} == {"Browser State", "Library", "Other"}
