import random
import re

from pyspark.sql import functions as F

from lintlake.operators import extract as E
from lintlake.operators import process as R
from lintlake.sources import scope as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_endpoints_and_negative(docs):
    d = docs({"u": 'fetch("/api/v1/users"); fetch("/api/v1/users"); x.open("GET", "/y")', "n": "const a = 1", "z": None})
    assert rows(E.endpoints(d), "source_url", "pattern_name", "value") == [("u", "fetch_call", "/api/v1/users"), ("u", "rest_api_path", "/api/v1/users"), ("u", "xhr_open", "/y")]


def test_parameters_take_the_nearest_function(docs):
    text = "function a() {\n  const userId = 1;\n}\nconst b = async () => {\n  let authToken = 2; let plain = 3;\n}\n" + "\n" * 60 + "var isAdmin = 1;\n'?redirectUrl=1&userId=2'"
    got = rows(E.parameters(docs({"u": text})), "name", "function_name", "line")
    assert sorted(got, key=lambda x: x[0]) == [("authToken", "b", 5), ("isAdmin", None, 67), ("redirectUrl", None, 68), ("userId", "a", 2)]


def test_dom_taint_takes_the_nearest_source_within_reach(docs):
    far = "location.hash\n" + "\n" * 40 + "x.innerHTML = 1\n"
    near = "const a = location.search;\nconst b = window.name;\nel.innerHTML = b;\nif (c == d) x.innerHTML == 2;"
    assert rows(E.dom_taint(docs({"f": far})), "sink_name") == []
    assert rows(E.dom_taint(docs({"n": near})), "source_name", "source_line", "sink_line", "sink_category", "variable_bridge") == [("window.name", 2, 3, "xss", "b")]


def test_jwt_decode_without_options(docs):
    d = docs({"a": "jwtDecode(t)", "b": "decode(t), { verify: 1 }"})
    assert rows(E.auth_findings(d), "source_url", "finding_type") == [("a", "jwt_decode_no_verify")]


def test_pages(docs):
    page = '<html><a href="/p?x=1">a</a><a href="https://o.example/">o</a><a href="javascript:x">j</a><form method=\'POST\' action="go"></form><script src="//c.example/s.js"></script><script type="text/template">aaaaaaaaaaaaaaaaaaaaaaaa</script><script>var aaaaaaaaaaaaaaaaa = 1;</script>'
    d = docs({"https://a.example/d/i": page})
    assert rows(E.html_links(d), "pattern_name", "value") == [("html_form_post", "/d/go"), ("html_link", "/p?x=1")]
    assert rows(E.third_party_scripts(d), "hostname", "script_url") == [("c.example", "https://c.example/s.js")]
    assert rows(E.inline_scripts(d), "url", "content") == [("inline:https://a.example/d/i#script-2", "var aaaaaaaaaaaaaaaaa = 1;")]


def test_source_maps(docs):
    d = docs({"m": '{"sources": ["a", 1, "c", "d"], "sourcesContent": ["x", "y", ""]}', "bad": '{"sourcesContent": ', "none": '{"sources": ["a"]}'})
    assert rows(E.source_map_files(d), "url", "content") == [("m (source map: a)", "x")]


def test_cors_and_missing_headers(docs):
    ok = {"access-control-allow-origin": "*", "access-control-allow-credentials": " TRUE "}
    d = docs({"a": "", "b": "", "c": ""}, {"a": ok, "b": {"access-control-allow-origin": "*"}})
    assert rows(E.cors(d), "source_url") == [("a",)]


def test_empty_tables(docs):
    d = docs({}).limit(0)
    for f in (E.endpoints, E.parameters, E.symbols, E.comments, E.feature_flags, E.graphql_operations, E.websockets, E.auth_findings, E.dom_findings, E.dom_taint, E.proto_pollution, E.postmessage, E.workers, E.cors, E.dependencies, E.html_links, E.entropy_tokens):
        assert f(d).count() == 0, f.__name__


def test_entropy_leaves_known_hashes_out(spark, docs):
    d = docs({"u": '"Zx9Kq2LmP8vR4tWyB6nDfH3sJ7uC1gA5"\n"aaaaaaaaaaaaaaaaaaaaaaaa"'})
    got = E.entropy_tokens(d).collect()
    assert len(got) == 1 and got[0].redacted_value.startswith("Zx9K***")
    assert E.entropy_tokens(d, spark.createDataFrame([(got[0].partial_hash,)], "partial_hash string")).count() == 0


def test_scope(spark):
    s = S.parse_text("# c\n*.a.example\nb.example\n!x.a.example\n")
    s = S.Scope(s.included, s.excluded, ("/private/*",))
    urls = spark.createDataFrame([("https://q.a.example/",), ("https://x.a.example/",), ("https://B.example:8443/private/k",), ("https://c.example/",), ("b.example",), (None,)], "url string")
    got = {r.url: (r.allowed, r.reason) for r in S.decisions(urls, s).collect()}
    assert [got[u][0] for u in ("https://q.a.example/", "https://x.a.example/", "https://B.example:8443/private/k", "https://c.example/", "b.example", None)] == [True, False, False, False, True, False]
    assert got["https://B.example:8443/private/k"][1] == "excluded path: /private/k"


def test_asset_graph(docs):
    d = docs({"w": '__webpack_require__;\nimport(/* webpackChunkName: "n" */ "./c.js");\nimport a from "m";', "v": "__vite__mapDeps; _vitePreload(() => import('./v.js'));", "x": '"/_next/static/chunks/page.ab.js" __NEXT_DATA__', "p": 'import("./q.js")'})
    got = {r.chunk_url: (r.chunk_name, r.bundler) for r in R.asset_nodes(d).collect()}
    assert got == {"w": (None, "webpack"), "./c.js": ("n", "webpack"), "./v.js": (None, "vite"), "/_next/static/chunks/page.ab.js": ("page", "next"), "p": (None, "unknown")}


def test_normalized_keeps_last_values_and_first_place(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "a", "z"), (4, None, None)], "ord int, k string, v string")
    got = {r.k: (r.v, r.ord, r.first_order) for r in R.normalized(df, ["k"], "ord").collect()}
    assert got == {"a": ("z", 3, 1), None: (None, 4, 2)}


def test_batches_and_templates(spark):
    ids = spark.createDataFrame([(i,) for i in range(103)], "i bigint").repartition(5)
    got = {r.i: r.batch for r in R.batches(ids, "i", 10).collect()}
    assert got == {i: i // 10 for i in range(103)}
    values = spark.createDataFrame([("/a/{id}",), ("/a/b",), ("/{x}/c",), ("/q",)], "value string")
    paths = spark.createDataFrame([("/a/7",), ("/z/c",), ("/a/b/c",)], "path string")
    assert rows(R.template_matches(values, paths), "value") == [("/a/{id}",), ("/{x}/c",)]


def test_template_matches_equal_all_pairs(spark):
    rng = random.Random(5)
    piece = lambda own: rng.choice(["a", "b", "", "4711", "a.b", ":id", "{id}", "{x", "é", *own])
    values = ["/a/{id}\r\n", "/a/{id}\n", "a/:id", "", "?a", "/", None] + ["/".join(piece([":x", "{a}?q=1", "{b}#f", "a?b"]) for _ in range(rng.randint(1, 5))) for _ in range(1500)]
    paths = ["/a/1", "/a/1\r\n", "/a/", "", "/", None] + ["/" * rng.randint(0, 1) + "/".join(piece(["a?b", "#"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    wild = lambda s: re.fullmatch(r":\w+|\{\w+\}", s, re.A)
    parts = lambda v: re.match("[^?#]*", v if v.startswith("/") else "/" + v)[0].split("/")
    fits = lambda s, r: len(s) == len(r) and all(a == b or wild(a) and b != "" for a, b in zip(s, r, strict=True))
    want = {v for v in values if v is not None and any(p is not None and fits(parts(v), p.split("/")) for p in paths)}
    got = R.template_matches(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(rows(got, "value")) == sorted((v,) for v in want) and len(want) > 100 and "/a/{id}\r\n" not in want


def test_template_matches_joins_no_pairs(spark):
    values = spark.createDataFrame([(f"/api/{{id}}?q={i}",) for i in range(300)], "value string")
    paths = spark.createDataFrame([(f"/api/{i}",) for i in range(300)], "path string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = R.template_matches(values, paths)
        assert len(got.collect()) == 300
        todo, most = [got._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName():
                most = max(most, node.metrics().apply("numOutputRows").value())
        assert 0 < most <= 600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_sinks_and_streaming(spark, docs, tmp_path):
    from lintlake.sources import sinks
    from lintlake.streaming import incremental

    d = docs({"u": 'fetch("/api/a")'})
    sinks.write_family(d.drop("headers"), str(tmp_path), "files", "r1")
    sinks.write_wordlist(spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "v string"), "v", str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["a", "b"]
    assert "| u |" in sinks.render_markdown({"t": d.select("url")})
    stream = incremental.document_stream(spark, str(tmp_path / "files" / "*"), d.drop("headers").schema)
    incremental.write_findings(stream, {"e": E.endpoints}, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "e")).where(F.col("pattern_name") == "fetch_call").count() == 1
