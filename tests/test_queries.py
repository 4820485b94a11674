"""Every query with an oracle, against DuckDB."""

import pytest

import __spark_entry__
from quillstone.plans import registry
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, name):
    assert_same(spark, sf_dir, registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["id", "name", "description"]
    assert out.count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
