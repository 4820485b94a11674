"""Golden cases of the catalogue."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import text as fn
from quillstone.operators import catalog
from quillstone.plans import bindings, registry
from quillstone.sources import library_json

NOW = "2024-05-01 10:00:00"


def notebooks(spark, rows):
    """rows: (id, name, description, topics, tags, use_count)"""
    data = [(i, f"https://x/{i}", n, d, t, [], [], g, None, None, u, None, k) for k, (i, n, d, t, g, u) in enumerate(rows)]
    return spark.createDataFrame(data, catalog.SCHEMA)


def state(spark, active):
    return spark.createDataFrame([(active,)], catalog.STATE)


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture(scope="module")
def three(spark):
    return notebooks(spark, [("z", "Zed", "plain", ["api", "rest"], ["A"], 0), ("a", "İstanbul", "50 % off", ["x"], ["b c"], 0), ("m", "Mid", None, [], [], 2)])


@pytest.mark.parametrize(("query", "want"), [("API Rest", ["z"]), ("", ["a", "m", "z"]), ("%", ["a"]), ("_", []), ("https", []), ("b C", ["a"]), ("i̇stan", ["a"]), ("zED", ["z"])])
def test_search(three, query, want):
    assert ids(catalog.search(three, query)) == want


def test_slug(spark):
    df = spark.createDataFrame([("My_Docs  A",)], "name string")
    assert df.select(fn.slug(F.col("name"))).first()[0] == "my-docs--a"


def test_parse_list(spark):
    df = spark.createDataFrame([("a,, b,\tc ,",)], "s string")
    assert df.select(fn.parse_list(F.col("s"))).first()[0] == ["a", "", "b", "c", ""]
    assert spark.range(1).select(fn.parse_optional_list(F.lit(None).cast("string"))).first()[0] == []


def test_insert_duplicates(spark, three):
    requests = spark.createDataFrame([("New One", "u", "d", "t1, t2", "", None, 10), ("new_one", "u", "d", "t", "", None, 11), ("Z", "u", "d", "t", "g", "c", 12)], "name string, url string, description string, topics string, tags string, use_cases string, ordinal long")
    after, rejected = catalog.insert(three, catalog.new_rows(requests, NOW))
    assert ids(after) == ["a", "m", "new-one", "z"]
    assert sorted(r.ordinal for r in rejected.collect()) == [11, 12]
    row = after.filter("id = 'new-one'").first()
    assert (row.topics, row.tags, row.use_cases, row.use_count, row.last_used) == (["t1", "t2"], [], [], 0, None)


@pytest.mark.parametrize("name", ["lib_insert", "lib_insert_rejected"])
def test_insert_queries_meet_taken_ids(spark, sf_dir, tmp_path, monkeypatch, name):
    part = bindings.table(spark, sf_dir, "part").filter("p_partkey < 20")
    part.crossJoin(spark.range(3)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 21).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    seen, insert = [], catalog.insert
    monkeypatch.setattr(catalog, "insert", lambda *x: seen.append(x) or insert(*x))
    got = {r.ordinal for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    held, rows = ({(r.id, r.ordinal) for r in x.collect()} for x in seen[0])
    taken = {k for i, k in rows if i in {i for i, _ in held}}
    assert held and taken and len(held) + len(rows) == 60
    assert taken <= got if name == "lib_insert_rejected" else not taken & got and {k for _, k in held} <= got


def test_first_insert_activates(spark, three):
    assert catalog.activate_only(three.limit(0).union(three.filter("id = 'a'")), state(spark, None)).first()[0] == "a"
    assert catalog.activate_only(three, state(spark, "m")).first()[0] == "m"


@pytest.mark.parametrize(("active", "gone", "want"), [("a", "a", "z"), ("z", "a", "z"), ("z", "z", "a"), ("a", "no", "a")])
def test_remove(spark, three, active, gone, want):
    assert catalog.reassign(three, state(spark, active), gone).first()[0] == want
    assert gone not in ids(catalog.remove(three, gone))


def test_remove_last(spark, three):
    one = three.filter("id = 'z'")
    assert catalog.reassign(one, state(spark, "z"), "z").first()[0] is None


def test_patch(spark, three):
    changes = spark.createDataFrame([("z", "New Name", "", None)], "id string, name string, description string, topics array<string>")
    row = {r.id: r for r in catalog.patch(three, changes, NOW).collect()}
    assert (row["z"].id, row["z"].name, row["z"].description, row["z"].topics, str(row["z"].updated_at)) == ("z", "New Name", "", ["api", "rest"], NOW)
    assert (row["a"].name, row["a"].updated_at) == ("İstanbul", None)
    assert ids(catalog.unknown(spark.createDataFrame([("q",), ("z",)], "id string"), three)) == ["q"]


def test_active(spark, three):
    assert catalog.active(three, state(spark, "gone")).first().id is None
    assert catalog.active(three, state(spark, "m")).first().name == "Mid"
    assert {r.id: r.title for r in catalog.render(three, state(spark, "z")).collect()}["z"] == "Zed [ACTIVE]"
    assert tuple(catalog.activate(three, state(spark, "z"), "nope").first()) == ("z", False)


def test_stats(spark):
    rows = notebooks(spark, [("z", "Z", "", ["A"], [], 0), ("a", "A", "", ["a", "A"], [], 0)])
    s = catalog.stats(rows, state(spark, "a")).first()
    assert (s.total_notebooks, s.total_topics, s.total_use_count, s.most_used_notebook, s.active_notebook) == (2, 2, 0, "z", "a")
    assert catalog.most_used(rows).first().id == "z"
    e = catalog.stats(rows.limit(0), state(spark, None)).first()
    assert (e.total_notebooks, e.total_topics, e.total_use_count, e.most_used_notebook, e.active_notebook) == (0, 0, 0, None, None)


def test_library_file(spark, three, tmp_path):
    path = library_json.write_library(three, state(spark, "m"), str(tmp_path), NOW)
    back, st = library_json.read_library(spark, path)
    assert [r.id for r in catalog.in_order(back).collect()] == ["z", "a", "m"]
    assert st.first()[0] == "m"
    assert back.filter("id = 'z'").first().topics == ["api", "rest"]


def test_library_file_order_and_defaults(spark, tmp_path):
    f = tmp_path / "library.json"
    f.write_text('{\n "notebooks": {"zeta": {"name": "Z", "topics": ["t"], "created_at": "2024-01-01T10:00:00"}, "alpha": {"name": "A", "use_count": 3, "created_at": "2024-01-01T10:00:00.123456"}},\n "active_notebook_id": null}')
    rows = library_json.read_library(spark, str(f))[0].orderBy("ordinal").collect()
    assert [(r.id, r.topics, r.use_count) for r in rows] == [("zeta", ["t"], None), ("alpha", [], 3)]
    assert str(rows[1].created_at) == "2024-01-01 10:00:00.123456"


def test_library_file_corrupt(spark, tmp_path):
    f = tmp_path / "library.json"
    f.write_text("{not json")
    assert library_json.read_library(spark, str(f))[0].count() == 0
    with pytest.raises(library_json.CorruptLibrary):
        library_json.read_library(spark, str(f), strict=True)
    assert f.read_text() == "{not json"


@pytest.mark.parametrize(("n", "want"), [(0, "0.0 B"), (512, "512.0 B"), (1280, "1.2 KB"), (1048575, "1024.0 KB"), (5 * 1024**4, "5.0 TB"), (1024**5 * 3, "3072.0 TB"), (1536, "1.5 KB")])
def test_format_size(spark, n, want):
    assert spark.createDataFrame([(n,)], "n long").select(fn.format_size(F.col("n"))).first()[0] == want


def test_urls(spark):
    df = spark.createDataFrame([("https://x.org/?u=https://host/",), ("https://host/a",), (None,)], "u string")
    got = df.select(fn.mentions(F.col("u"), "https://host/"), fn.on_host(F.col("u"), "host")).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (False, False)]


def test_scan_is_whole(spark, sf_dir, tmp_path):
    part = bindings.table(spark, sf_dir, "part").limit(100).drop("p_partkey")
    part.crossJoin(spark.range(25)).withColumn("p_partkey", F.row_number().over(Window.orderBy("p_name", "id")).cast("long")).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    base = bindings.catalog(spark, str(tmp_path)).orderBy("ordinal").collect()
    got = sorted(registry.QUERIES["lib_scan"](spark, str(tmp_path)).collect())
    assert len(got) == 2500 and [tuple(r) for r in got] == [(k, r.id, r.name, r.topics, r.use_count) for k, r in enumerate(base)]


def test_blocks_number_across_gaps(spark):
    rows = notebooks(spark, [(f"n{k}", "N", None, [], [], k) for k in range(40)]).filter("ordinal % 3 <> 0 and ordinal not between 10 and 19")
    text = library_json.to_json_blocks(rows, state(spark, "n1"), NOW, block=5)
    found = library_json.parse(text).select("before", F.posexplode("doc.notebooks").alias("at", "id", "n")).collect()
    assert text.count() == 6
    assert [r.id for r in sorted(found, key=lambda r: r.before + r.at)] == [r.id for r in rows.orderBy("ordinal").collect()]
    assert sorted(r.before + r.at for r in found) == list(range(rows.count()))
