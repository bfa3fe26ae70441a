from pyspark.sql import functions as F

from lintlake.operators import report as O


def test_ssrf_and_numeric_id(spark):
    rows = ["/proxy?u=1", "/x?targetUrl=a", "/profileUrl", "/api?webhook_uri=1", "/a?valid=1", "/a?user_id=5", "/a?userId=x", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, value string")
    got = {r.i: (r.s, r.n) for r in df.select("i", O.ssrf_shape(F.col("value")).alias("s"), O.numeric_id_parameter(F.col("value")).alias("n")).collect()}
    assert [got[i][0] for i in range(9)] == [True, True, False, True, False, False, False, False, False]
    assert [got[i][1] for i in range(9)] == [False, False, False, False, False, True, False, False, False]


def test_unsigned_tokens(spark):
    none, upper, signed = "eyJhbGciOiJub25lIn0.eyJzdWIiOiIxIn0.", "eyJhbGciOiJOT05FIn0.eyJzdWIiOiIxIn0.x", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.x"
    df = spark.createDataFrame([(1, "u", f"a {none} {none} {upper}"), (2, "u", signed), (3, "u", "eyJ@@@@@@.a.b eyJub3RqIHNvbn0.eyJub3RqIHNvbn0."), (4, "u", None), (5, None, "")], "file_id int, url string, content string")
    assert [r.file_id for r in O.unsigned_tokens(df).collect()] == [1, 1]


def test_retire_reports(spark):
    entry = '[{"file": "a.js", "results": [{"component": "x", "version": "1", "vulnerabilities": [{"identifiers": {"CVE": ["CVE-1"]}}, {}]}, {"component": "y"}]}, 3]'
    df = spark.createDataFrame([(1, entry), (2, '{"data": ' + entry[:-4] + "]}"), (3, "none"), (4, None), (5, "[]"), (6, "{}")], "id int, payload string")
    rows = sorted((r.id, r.name, tuple(r.cves)) for r in O.retire_reports(df).collect())
    assert [r for r in rows if r[0] == 2] == [(2, "x", ()), (2, "x", ("CVE-1",))] and {r[0] for r in rows} <= {1, 2}


def test_first_source_and_lookup(spark):
    a, b = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    assert sorted((r.k, r.v) for r in O.first_source([a, b], "k").collect() if r.k) == [(1, "a"), (2, "c"), (2, "d")]
    assert sorted(tuple(r) for r in O.first_by(b, "k", ["v"], ["v"]).collect()) == [(1, "b"), (2, "c")]


def test_coverage_and_changes(spark):
    c = spark.createDataFrame([("p", "PASS"), ("p", "FAILED"), ("q", "SKIPPED"), ("q", "PASS"), ("r", None)], "phase string, status string")
    assert {r.phase: (r.checks, r.coverage, r.passed) for r in O.phase_coverage(c).collect()} == {"p": (2, 0.5, False), "q": (2, 0.5, True), "r": (1, 0.0, False)}
    runs = spark.createDataFrame([("a",), ("b",), ("b",)], "scan_run_id string")
    changes = spark.createDataFrame([("b", "new", "/x"), ("b", "new", None), ("a", "other", "/y")], "scan_run_id string, diff_field string, item string")
    assert {r.scan_run_id: r.has_changes for r in O.changed_runs(runs, changes, ["new"]).collect()} == {"a": False, "b": True}
    assert sorted((r.part, r.text) for r in O.change_lines(changes, {"new": "+{n}"}, "new").collect()) == [(0, "+2"), (1, "  `/x`"), (1, "  ``")]


def test_streams_and_normal_forms(spark):
    files = spark.createDataFrame([(1, "a", " <p>", None), (2, "b", "x", "runtime"), (3, "c", "<p>", "fetch"), (4, "d", None, None)], "file_id int, url string, content string, origin string")
    auth = spark.createDataFrame([("c",), ("c",), (None,)], "url string")
    assert {r.file_id: r.stream for r in O.document_streams(files, auth).collect()} == {1: "page", 2: "runtime", 3: "auth", 4: "js"}
    rows = spark.createDataFrame([("w", None, "u", 1), ("w", None, "u", 3), ("w", "x", "u", 2)], "worker_type string, worker_url string, source_url string, o int")
    assert {(r.worker_url, r.o, r.first_order) for r in O.normal_form(rows, "workers", "o").collect()} == {("__dynamic__", 3, 1), ("x", 2, 2)}
    assert O.normal_form(rows.limit(0), "workers", "o").count() == 0
