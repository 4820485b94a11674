"""The command line, in process."""

import datetime as dt
import json

import pytest

from quillstone.__main__ import main
from quillstone.operators import catalog, sessions, storage
from quillstone.sources import library_json, listing


@pytest.fixture
def run(spark, tmp_path, capsys):
    def call(*words):
        code = main([str(tmp_path), *words])
        return code, capsys.readouterr().out

    return call


def test_catalogue_commands(run):
    assert run()[0] == 1
    assert run("ask", "--question", "q", "--polls", "none")[0] == 1
    assert run("add", "--url", "u1", "--name", "First Book", "--description", "d", "--topics", "a, b") == (0, "first-book\n")
    assert run("add", "--url", "u2", "--name", "first book", "--description", "d", "--topics", "a")[0] == 1
    assert run("add", "--url", "u2", "--name", "Second", "--description", "d", "--topics", "c", "--tags", "t")[0] == 0
    assert run("use", "--id", "second")[0] == 0
    assert run("update", "--id", "second", "--name", "Renamed", "--tags", "")[0] == 0
    assert run("update", "--id", "no", "--name", "x")[0] == 1
    code, out = run("search", "--query", "RENAM")
    assert code == 0 and out.startswith("1 found") and "second" in out
    code, out = run("stats")
    assert code == 0 and "notebooks: 2" in out and "active: First Book (0 uses)" in out and "most used: Renamed (1 uses)" in out and "library: " in out
    assert "First Book [ACTIVE]" in run("list")[1]
    assert run("activate", "--id", "second")[0] == 0 and "Renamed [ACTIVE]" in run("list")[1]
    assert run("remove", "--id", "second")[0] == 0 and run("remove", "--id", "second")[0] == 1


def test_ask(run, spark, tmp_path):
    run("add", "--url", "u1", "--name", "Book", "--description", "d", "--topics", "a")
    at = dt.datetime(2024, 1, 1)
    texts = ["...", "part", "whole", "whole", " whole ", "whole", "whole"]
    rows = [("u1", at + dt.timedelta(seconds=k), k, x, x == "...") for k, x in enumerate(texts)] + [("u2", at, 0, "never", False)]
    polls = f"{tmp_path}/polls"
    spark.createDataFrame(rows, "url string, ts timestamp_ntz, seq long, text string, thinking boolean").write.parquet(polls)
    code, out = run("ask", "--question", "What?", "--polls", polls)
    assert code == 0 and "Question: What?" in out and "\nwhole\n" in out and "Is that all you need to know?" in out
    assert run("ask", "--question", "q", "--polls", polls, "--url", "u2") == (1, "no answer\n")
    assert run("ask", "--question", "q", "--polls", polls, "--id", "no")[0] == 1


def test_status_and_storage(run, tmp_path):
    assert "authenticated: no" in run("status")[1]
    (tmp_path / "browser_state" / "state.json").write_text("{}")
    (tmp_path / "auth_info.json").write_text(json.dumps({"authenticated_at": 1.0, "authenticated_at_iso": "2024-01-01 00:00:00"}))
    out = run("status")[1]
    assert "authenticated: yes" in out and "state age: 0 hours (ok)" in out and "saved at: 2024-01-01 00:00:00" in out
    (tmp_path / "auth_info.json").write_text("not json")
    assert run("status")[0] == 0
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "a b.bin").write_bytes(b"x" * 2048)
    out = run("storage")[1]
    assert "Browser State: 1 items" in out and "Other: 1 items, 2.0 KB" in out
    assert run("storage", "--dry-run")[1].startswith("would delete 3 items")


def test_listing(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "z.txt").write_text("12345")
    (tmp_path / "top").write_text("1")
    assert sorted((r.path, r.size) for r in listing.files(spark, str(tmp_path)).collect()) == [("top", 1), ("x/y/z.txt", 5)]
    rows = storage.items(listing.files(spark, f"file://{tmp_path}").select("path", "size")).collect()
    assert sorted((r.path, r.type, r.size) for r in rows) == [("top", "file", 1), ("x", "dir", 5)]


def test_blocks_of_files(spark, tmp_path):
    rows = [(str(k), "u", f"n{k}", "d", ["t"], [], [], [], None, None, k, None, k * 10) for k in range(250)]
    base = spark.createDataFrame(rows, catalog.SCHEMA)
    state = spark.createDataFrame([("7",)], "active_id string")
    folder = library_json.write_blocks(base, state, f"{tmp_path}/blocks", "2024-01-01", 300)
    got, now = library_json.read_blocks(spark, folder)
    assert [(r.ordinal, r.id, r.use_count) for r in got.orderBy("ordinal").collect()] == [(k, str(k), k) for k in range(250)]
    assert [r.active_id for r in now.collect()] == ["7"]


def test_two_changes_for_one_id(spark):
    base = spark.createDataFrame([("a", "u", "n", "d", [], [], [], [], None, None, 0, None, 1)], catalog.SCHEMA)
    changes = spark.createDataFrame([("a", "first", None, 1), ("a", "second", "e", 2), ("a", None, None, 3)], "id string, name string, description string, at long")
    rows = catalog.patch(base, changes, "2024-01-01").collect()
    assert [(r.name, r.description) for r in rows] == [("second", "e")]


def test_sessions_until_closed(spark):
    events = spark.createDataFrame([(1, k, k, x) for k, x in enumerate(["a", "b", "close", "close", "c"])], "key long, ts long, seq long, text string")
    got = sorted(tuple(r) for r in sessions.until_closed(events, events.text == "close").select("session_no", "message_count", "closed").collect())
    assert got == [(0, 2, True), (1, 0, True), (2, 1, False)]
