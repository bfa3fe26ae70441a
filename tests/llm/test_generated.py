import random

from lintlake.llm import generated as G

HAND = """import { load } from './io'

// reads the list once and keeps it
export async function total(list, rate) {
  let sum = 0
  for (const item of list) {
    if (!item.price) continue
    sum += item.price * rate
  }
  const extra = await load('/api/v1/extra')
  return extra ? sum + extra.value : sum
}

class Cart {
  constructor(owner) { this.owner = owner; this.items = [] }
  add(x) { this.items.push(x); return this }
  get empty() { return this.items.length === 0 }
}
"""


def why(text, ext="js", library=None):
    return G.verdict(text, ext, library)


def measured(text, ext="js"):
    remarks = []
    return G.measure(text, ext == "py", (*G.lex(text, ext == "py", remarks), remarks))


def test_repair_expands_to_the_input():
    r = random.Random(1)
    for least in (2, 3):
        for _ in range(50):
            seq = [r.choice("abc") for _ in range(r.randint(0, 300))]
            rules, top, length, pairs = G.repair(seq, least)
            names = list(dict.fromkeys(seq))
            expand = lambda x: expand(pairs[x][0]) + expand(pairs[x][1]) if pairs[x] else [names[x]]
            assert [c for x in top.tolist() for c in expand(x)] == seq
            assert all(a >= 2 and b >= 1 for a, b in rules) and len(rules) == len(length) - len(names)
            left = list(zip(top.tolist(), top.tolist()[1:]))
            assert all(left.count(x) < least for x in left)
    rules, *_ = G.repair(list("abcd" * 64))
    assert max(a * b for a, b in rules) >= 250


def test_kinds():
    assert why(HAND) == ""
    assert why("// generated reports are listed here\n" + HAND) == ""
    assert why("\n".join(f"export function op{i}(c, r) {{\n  return c.invoke({i * 7}, 'S/Op{i}', r);\n}}\n" for i in range(20))) == "generated"
    r = random.Random(2)
    blob = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=900))
    assert why(f'const img = "{blob}";') == "data"
    assert why("T = [\n" + "\n".join("  " + ", ".join(str(r.randint(0, 9999)) for _ in range(8)) + "," for _ in range(20)) + "\n]\n", "py") == "data"
    assert why("!function(e,t){" + "".join(f"var {c}=e[{i}];if({c}>t)try{{{c}({c})}}catch(r){{{c}=void 0}}" for i, c in enumerate("abcdfghijkl")) + "}(window,1)") == "minified"
    assert why("<html>" + "<p>x</p>" * 50) == ""
    assert why("") == ""


def test_copies_of_a_library():
    library = G.Library.of([(HAND, False)])
    changed = "/* (c) someone */\n" + HAND.replace("'", '"').replace("\n", ";\n").replace("rate", "factor")
    assert why(HAND, "js", library) == why(HAND[: len(HAND) // 2], "js", library) == "vendored"
    assert why(HAND.replace("0", "1"), "js", library) == "vendored" and why(changed.replace(";;", ";"), "js", library) in ("vendored", "")


def test_operator(spark):
    code = "\n".join(f"export type A{i} = {{ f{i}: number }};\n" for i in range(30))
    rows = [(1, "r", "u/a.ts", code, False), (2, "r", "u/a.ts", HAND, None), (3, "r", "u/a.json", code, True), (4, "r", "u/m (source map: b.MJS?x)", code, True), (5, None, None, code, None), (6, "r", "u/c.js", None, None), (7, "r", "u/d.js", HAND, None)]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, url string, content string, recovered_from_source_map boolean")
    libs = spark.createDataFrame([(1, "js", "x")], "lib_id bigint, lang string, content string")
    assert sorted(tuple(r) for r in G.classified(files, libs).collect()) == [(1, "generated"), (4, "generated")]
    assert G.classified(files, libs.limit(0)).count() == 2
    flags = spark.createDataFrame([("u/d.js", True), ("u/d.js", None), ("u/d.js", True)], "url string, recovered_from_source_map boolean")
    assert {r.file_id: r.recovered for r in G.hand_written(files, flags, libs).collect()} == {2: False, 7: True}


def test_libraries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_CHARS", 100)
    files = spark.createDataFrame([(1, "r", "a.js", HAND, None)], "file_id bigint, repo string, url string, content string, r boolean")
    libs = spark.createDataFrame([(i, "js", HAND if i == 2 else f"var a{i} = {i};") for i in range(4)], "lib_id bigint, lang string, content string")
    assert [tuple(r) for r in G.classified(files, libs).collect()] == [(1, "vendored")]


def test_banner_after_a_long_licence():
    code = HAND + "".join(f"export const f{i} = (a) => call({i}, a)\n" for i in range(8))
    banner, licence = "Code generated by protoc-gen-x. DO NOT EDIT.", "Licensed as it stands, without warranty of any kind.\n"
    assert measured(code)["reuse"] >= 0.4 and why(code) == ""
    for head in ("// " + licence) * 60 + "// " + banner + "\n", "/*\n" + licence * 60 + banner + "\n*/\n":
        assert len(head) > 3000 and why(head + code) == "generated"
    assert why(("// " + licence) * 60 + code + f"\nwrite('// {banner}')\n") == ""  # a generator's own literal
    assert measured(("# " + licence) * 60 + f'"""{banner}"""\nx = 1\n', "py")["banner"] == 1.0


def test_shared_rules_count_what_both_sides_use():
    r = random.Random(3)
    a, b = ([f"t{r.randint(0, 400)}" for _ in range(300)] for _ in range(2))
    assert G.shared_rules(a, a) > 0.95 and G.shared_rules(a, b) == 0.0
    assert 0.4 < G.shared_rules(a, a[:150] + b[:150]) < 0.6
    assert G.shared_rules(a, b * 3) == 0.0  # repeated by itself alone


def test_verdicts_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(5)
    source = lambda k: "".join(f"function f{k}_{i}(a, b) {{ if (a > {r.randint(0, 99)}) return g{r.randint(0, 999)}(b + {i}) }}\n" for i in range(12))
    one, two, own = source(1), source(2), HAND * 2
    table = "T = [" + ", ".join(str(i * 37 % 9999) for i in range(80)) + "]\n"
    texts = [one, two + "\n// kept", one + two, own + one[:200], table, one[: len(one) // 2], HAND]
    files = spark.createDataFrame([(i, "r", "a.js", x) for i, x in enumerate(texts)], "file_id bigint, repo string, url string, content string")
    libs = spark.createDataFrame([(1, "js", one), (2, "js", two), (3, "js", None)], "lib_id bigint, lang string, content string")
    want = sorted(map(tuple, G.classified(files, libs).collect()))
    monkeypatch.setattr(G, "BLOCK_CHARS", 1)
    assert sorted(map(tuple, G.classified(files, libs).collect())) == want and {(0, "vendored"), (1, "vendored"), (4, "data"), (5, "vendored")} <= set(want)
