"""Every query over empty tables, over tables of nulls, and over the smallest test tables."""

import os

import pytest
from codelode.llm.queries import queries

DATA = "/root/testdata/sf0.001"
TABLES = {
    "chunk_vectors": "vec_id bigint, project_id string, rel_path string, chunk_index int, vector array<float>, created_at timestamp_ntz",
    "chunks": "chunk_id bigint, project_id string, rel_path string, chunk_index int, start_line int, end_line int, content string, symbol_name string, ingested_at timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, project_id string, created_at timestamp_ntz, ingested_at timestamp_ntz",
    "files": "project_id string, rel_path string, extension string, size_bytes bigint, last_modified double, scanned_at timestamp_ntz",
    "file_kinds": "extension string, lang_name string, has_grammar boolean",
    "split_limits": "extension string, max_chars int, overlap_chars int",
    "pack_budgets": "budget_name string, capacity_tokens int",
}


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, spark, tmp_path_factory):
    at = tmp_path_factory.mktemp(request.param)
    for name, schema in TABLES.items():
        rows = [] if request.param == "empty" else [tuple(None for _ in schema.split(", "))] * 3
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", queries())
def test_empty_and_null_tables(spark, folder, name):
    rows = queries()[name](spark, folder).collect()
    if name.endswith("_found") and name not in ("p3_found",):
        assert rows == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", queries())
def test_small_tables(spark, name):
    df = queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0
