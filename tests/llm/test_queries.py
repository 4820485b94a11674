"""Queries with an oracle against DuckDB, and the shape of the others."""

import pytest

from quillstone.llm import queries
from tests.oracle import assert_same

SHAPES = {
    "op1_html_extract": ["page_id", "url", "text", "n_chars"],
    "op2_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10_packing": ["doc_id", "piece", "start", "n_tokens", "bucket_len", "batch_id", "slot"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert out.columns == SHAPES[name]
    tables = {"op1_html_extract": "pages"}
    want = queries.table(spark, sf_dir, tables.get(name, "documents")).count()
    assert out.count() >= want if name == "op10_packing" else out.count() == want
