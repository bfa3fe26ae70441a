import math
import re

import pytest
from pyspark.sql import functions as F

from lintlake.functions import patterns as P
from lintlake.functions import registry
from lintlake.functions import text as X
from lintlake.functions.text import Pattern
from lintlake.plans.corpus import documents

FAMILIES = [P.ENDPOINTS, P.SYMBOLS, P.FLAGS, P.AUTH, [p for _, p in P.PROTO], P.WEBSOCKETS, P.WORKERS, P.TAINT_SOURCES, P.TAINT_SINKS, [P.LINE_COMMENT, P.BLOCK_COMMENT], [P.POST_SEND, P.POST_LISTEN]]


def _flags(p):
    return sum({"i": re.I, "s": re.S, "m": re.M}[f] for f in p.flags)


@pytest.mark.parametrize("family", range(len(FAMILIES)))
def test_hits_agree_with_python(spark, data, family):
    """Every match with its line, over the generated scripts and the stored files."""
    patterns = FAMILIES[family]
    df = documents(spark, data).where("content is not null").select("file_id", "content")
    rows = df.select("file_id", F.explode(X.hits("content", patterns)).alias("h")).select("file_id", "h.*").collect()
    got = sorted((r.file_id, r.pat_ord, r.match_ord, r.line, r.text, r.value) for r in rows)
    want = []
    for d in df.collect():
        for k, p in enumerate(patterns):
            for n, m in enumerate(re.finditer(p.regex, d.content, _flags(p)), 1):
                want.append((d.file_id, k, n, 1 + d.content.count("\n", 0, m.start()), m.group(), m.group(p.group) or ""))
    assert got == sorted(want)


def test_lines_with_mixed_line_ends_and_unicode(spark):
    t = "é\r\nfoo é foo\nfoo\r\n\nfoo"
    df = spark.createDataFrame([(t,), (None,), ("",)], "c string")
    rows = df.select(X.hits("c", [Pattern("f", "foo")]).alias("h")).collect()
    assert [h.line for h in rows[0].h] == [2, 2, 3, 5] and rows[1].h == [] and rows[2].h == []


def test_long_adversarial_texts_do_not_overflow(spark):
    evil = ["f.postMessage(" + "a" * 200_000, "f.postMessage(" + "{}" * 50_000 + ", '*')", "a." * 50_000 + "example.com", "<script " + "x" * 100_000, "console.log(" + "token" * 5000, "/*" * 50_000, "'" * 50_000]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(evil)], "file_id bigint, url string, content string")
    for p in (P.POST_SEND, P.SCRIPT, P.BLOCK_COMMENT, P.AUTH[8]):
        df.select(F.size(X.hits("content", [p]))).collect()
    from lintlake.operators import extract
    from lintlake.sources import scope

    assert extract.subdomains(df, ["example.com"], scope.decide(scope.Scope(("example.com",)))).count() == 1


def test_scalar_kernels(spark):
    df = spark.createDataFrame([("userIdToken-fooURL2Bar_x",)], "n string")
    assert df.select(X.words(F.col("n"))).first()[0] == ["user", "id", "token", "foo", "url2", "bar", "x"]
    t = "aabbccddeeffgghhiijjkkllmmnnoopp"
    got = spark.createDataFrame([(t,)], "t string").select(X.entropy(F.col("t"))).first()[0]
    assert math.isclose(got, 4.0)


@pytest.mark.parametrize(
    "ref, want",
    [
        ("x.js", "https://a.example/p/x.js"), ("/x", "https://a.example/x"), ("//b.example/y", "https://b.example/y"), ("?q=1", "https://a.example/p/page?q=1"), ("", "https://a.example/p/page?z=0"),
        ("../u/./v", "https://a.example/u/v"), ("http://c.example/", "http://c.example/"), ("mailto:a@b", "mailto:a@b"), ("../../../r", "https://a.example/r"),
    ],
)
def test_resolve(spark, ref, want):
    df = spark.createDataFrame([("https://a.example/p/page?z=0", ref)], "b string, r string")
    assert df.select(X.resolve(F.col("b"), F.col("r"))).first()[0] == want


def test_registry(spark, docs):
    registry.register_pattern("mine", "todo", r"TODO\((\w+)\)", 1)
    rows = registry.find_all(docs({"u": "a\nTODO(me)"}), "mine").collect()
    assert [(r.line, r.value) for r in rows] == [(2, "me")]
    registry.register_sql(spark)
    assert spark.sql("select identifier_words('userId'), path_template('/a/{id}/1234')").first() == (["user", "id"], "/a//REPLACE_ID/REPLACE_ID")


def test_dom_taint_against_brute_force(spark, data):
    """The nearest-source rule, over the generated scripts and the stored files."""
    from lintlake.operators import extract

    df = documents(spark, data).where("content is not null")
    got = {tuple(r) for r in extract.dom_taint(df).collect()}
    want = set()
    for d in df.select("file_id", "url", "content").collect():
        line = lambda m, t=d.content: t.count("\n", 0, m.start()) + 1
        sources = [(line(m), p.name) for p in P.TAINT_SOURCES for m in re.finditer(p.regex, d.content)]
        for p in P.TAINT_SINKS:
            for m in re.finditer(p.regex, d.content):
                at = line(m)
                near = [s for s in sources if abs(s[0] - at) <= P.TAINT_REACH]
                if near:
                    s = min(near, key=lambda x: abs(x[0] - at))
                    between = "\n".join(d.content.split("\n")[min(s[0], at) - 1 : max(s[0], at)])
                    bridge = re.search(P.ASSIGNED.regex, between)
                    want.add((d.file_id, d.url, s[1], s[0], p.name, at, P.TAINT_CATEGORY[p.name], bridge.group(1) if bridge else None))
    assert got == want and len(want) > 20
