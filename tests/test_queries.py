"""Queries against their SQL in another engine, on the smallest data."""

import os

import pytest

import __spark_entry__ as entry

CORE = ["p1_found", "p2_found", "p2_graphql_operations", "endpoints_docs", "parameters", "graphql_ops", "postmessage", "workers", "html_links", "scope_decision", "endpoint_tags", "api_groups", "graph_stats", "batch_ids", "normal_parameters", "normal_string_sets", "ssrf_shape", "jwt_alg_none", "retire_flatten", "dependency_priority", "change_messages", "object_authorization", "entry_points", "document_streams", "stream_first_seen"]


def _shape(x):
    if isinstance(x, float):
        return repr(round(x, 6))
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(_shape, x)) + "]"
    return str(x)


@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(_shape(r[k]) for k in cols) for r in df.collect())
    cur = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(_shape(r[names.index(k)]) for k in cols) for r in cur.fetchall())


def test_entry_and_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns == ["scan_run_id", "diff_field", "item"]


def test_core_does_not_need_the_text_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "lintlake"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lintlake.llm" not in p.read_text(), p


def test_found_queries_have_the_given_columns(spark, data):
    want = {"p1_found": ["scan_run_id", "diff_field", "item"], "p2_found": ["record_id", "path", "parent_path"]}
    for name, cols in want.items():
        assert entry.queries()[name](spark, data).columns == cols
