"""The graph and the interest counts hold every family of findings."""

import pytest
from test_queries import test_same_as_sql as same_as_sql

import __spark_entry__ as entry
from lintlake.functions import patterns as P


@pytest.mark.parametrize("name", ["graph_full_nodes", "graph_full_edges", "graph_full_stats"])
def test_full_graph_is_the_same_as_sql(spark, data, name):
    same_as_sql(spark, data, name)


def test_full_graph_has_all_kinds(spark, data):
    kinds = {r.kind for r in entry.queries()["graph_full_nodes"](spark, data).select("kind").distinct().collect()}
    assert kinds == {"bundle", "url", "endpoint", "secret", "subdomain", "parameter", "dom_finding"}


def test_interest_counts_object_access(spark, data):
    rows = entry.queries()["interest_score"](spark, data).collect()
    assert sum(r.object_access for r in rows) > 0
    assert all(r.score == sum(w * r[k] for k, w in P.INTEREST_WEIGHTS.items()) for r in rows)
