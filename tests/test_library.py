"""The change log: inserts, patches, removals, uses, and the active notebook."""

import pytest

from quillstone.library import Library


def test_life_of_a_library(spark, tmp_path):
    lib = Library(spark, str(tmp_path))
    assert lib.list().count() == 0 and lib.state().first().active_id is None
    assert lib.add("u1", "First Book", "d", ["a", "b"], "2024-01-01 10:00:00") == "first-book"
    assert lib.add("u2", "Second", "d2", ["b"], "2024-01-01 11:00:00", tags=["t"]) == "second"
    with pytest.raises(ValueError):
        lib.add("u", "first_book", "d", [], "2024-01-01 12:00:00")
    assert lib.state().first().active_id == "first-book"
    lib.activate("second", "2024-01-01 13:00:00")
    lib.use("second", "2024-01-01 14:00:00")
    lib.use("second", "2024-01-01 15:00:00")
    s = lib.stats().first()
    assert (s.total_notebooks, s.total_topics, s.total_use_count, s.active_notebook, s.most_used_notebook) == (2, 2, 2, "second", "second")
    lib.update("first-book", "2024-01-02 10:00:00", name="Renamed", description=None, tags=[])
    row = lib.get("first-book").first()
    assert (row.name, row.description, row.topics, str(row.updated_at), str(row.created_at)) == ("Renamed", "d", ["a", "b"], "2024-01-02 10:00:00", "2024-01-01 10:00:00")
    assert [r.id for r in lib.list().collect()] == ["first-book", "second"]
    assert [r.id for r in lib.search("RENAM").collect()] == ["first-book"]
    assert lib.remove("second", "2024-01-03 10:00:00") and not lib.remove("second", "2024-01-03 11:00:00")
    assert lib.state().first().active_id == "first-book"
    assert lib.add("u2", "Second", "again", [], "2024-01-04 10:00:00") == "second"
    assert lib.get("second").first().use_count == 0
    with pytest.raises(ValueError):
        lib.use("no", "2024-01-05 10:00:00")
