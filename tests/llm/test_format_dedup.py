import random

from lintlake.llm import format_dedup as D

SCHEMA = "endpoint_id bigint, value string, source_url string"


def _pairs(spark, rows):
    return {tuple(x) for x in D.duplicate_endpoints(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_spellings(spark):
    u = "https://a.example/x.js"
    rows = [
        (1, "/Api/V1/users?b=2&a=1", u), (2, "/api/v1/users/?a=1&b=2 ", "HTTPS://A.example/x.js;"), (3, "/api/v1/users?a=2&b=1", u), (4, "/api/users/v1?a=1&b=2", u),
        (5, "{ url: '/x', method: 'get' }", u), (6, 'METHOD: "GET", url: "/x"', u), (7, "{ url: 'get', method: '/x' }", u), (8, "{ a: { c: 1, b: [1, 2] }, z: 1 }", u),
        (9, "{ z: 1, a: { b: [1, 2], c: 1 } }", u), (10, "{ z: 1, a: { b: [2, 1], c: 1 } }", u), (11, None, u), (12, None, u), (13, "", u), (14, " /-", u), (15, None, None),
        (16, "/api/v1/users?b=2&a=1", "https://a.example/x.js?v=1&w=2"), (17, "/api/v1/users?a=1&b=2", "https://a.example/x.js?w=2&v=1"), (18, "/a?x=1&x=1", u), (19, "/a?x=1", u),
    ]
    assert _pairs(spark, rows) == {(1, 2), (5, 6), (8, 9), (11, 12), (13, 14), (16, 17)}


def test_hot_group_and_repeats(spark):
    r = random.Random(1)
    rows = [(i, "/hot?a=1&b=2" if i % 3 else f"/cold/{r.randint(0, 40)}", "u") for i in range(1, 900)]
    first = {}
    want = set()
    for i, v, _ in rows:
        if v in first:
            want.add((first[v], i))
        first.setdefault(v, i)
    assert _pairs(spark, rows) == want
    groups = {tuple(x) for x in D.collapsed_endpoints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(n for _, n in groups) == len(rows) and {f for f, _ in groups} == set(first.values())


def test_digest_clash_falls_back_to_structure(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = D.structures
    monkeypatch.setattr(D, "structures", lambda *a: real(*a).withColumn("root", F.lit(0).cast("bigint")))
    rows = [(1, "/a", "u"), (2, "/A", "u"), (3, "/b", "u"), (4, "/b/", "u"), (5, "/c", "u")]
    assert _pairs(spark, rows) == {(1, 2), (3, 4)}


def test_empty_long_and_extra_columns(spark):
    assert _pairs(spark, []) == set()
    long = "/api?" + "&".join(f"k{i}=v{i}" for i in range(20000))
    assert _pairs(spark, [(1, long, "u"), (2, long.upper() + "/", "u"), (3, "{" + "{" * 5000, "u")]) == {(1, 2)}
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "/a", "u"), (2, "/a/", "u")], SCHEMA).withColumns({"root": F.lit("x"), "canon": F.lit(1), "id": F.lit(0), "copies": F.lit(2)})
    assert D.duplicate_endpoints(df).count() == 1


def test_marks_count_at_every_depth(spark):
    u = "u"
    rows = [(1, "{ a: 'cafe', b: { c: 1 } }", u), (2, "{ b: { c: 1 }, a: 'cafe\u0301' }", u), (3, "{ a: 'cafe' }", u), (4, "{ A: 'cafe\u0301' }", u), (5, "{ b: { C: '1' }, a: \"cafe\" }", u)]
    assert _pairs(spark, rows) == {(1, 5)}


def test_digests_of_children_ignore_order_where_it_does_not_count():
    a, b = D.shape("{ z: 1, a: { b: [1, 2], c: 1 } }"), D.shape("{ a: { c: 1, b: [1, 2] }, z: 1 }")
    assert a == b
    assert D.shape("{ z: 1, a: { b: [2, 1], c: 1 } }")[1] != a[1]
    assert D.shape("{ z: 1, a: { b: [1, 2] }, c: 1 }")[1] != a[1]


def test_all_groups_hot_or_none(spark, monkeypatch):
    rows = [(i, f"/x{i % 7}?b={i % 2}&a=1" if i % 3 else f"/X{i % 7}/?A=1&b={i % 2}", "u") for i in range(1, 200)]
    want = _pairs(spark, rows)
    for share in (0.0, 1.0):
        monkeypatch.setattr(D, "HOT_SHARE", share)
        assert _pairs(spark, rows) == want


def test_same_as_sql(spark, data):
    import duckdb

    from lintlake.llm import queries as Q

    c = duckdb.connect()
    c.execute(f"create view endpoints as select * from '{data}/endpoints.parquet'")
    for name in ("p4_found", "p4_collapsed"):
        df = Q.QUERIES[name](spark, data)
        assert sorted(map(tuple, df.collect())) == sorted(c.execute(f"select {', '.join(df.columns)} from ({Q.ORACLES[name]})").fetchall())
