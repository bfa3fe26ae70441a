import ast
import json
import random
import re
import warnings
from functools import lru_cache

import pytest

from lintlake.llm import syntax as S

warnings.simplefilter("ignore")


@lru_cache
def permitted(lang):
    return {a + b for a, b in S.grammar(lang).pairs()}


def fault(lang, text):
    tokens, error = S.lex(lang, text)
    if error:
        return error
    return "pair" if S.adjacent_pairs(lang, tokens) - permitted(lang) else S.grammar(lang).fault(tokens)


GOOD = {
    "js": [
        "", "const a = 1", "let x = a ? b : c ? d : e;\nfoo()\n(b)", "async function* f({ a, b: [c = 1] = [] }, ...r) { for await (const x of y) yield* x; }", "class A extends (b, C) { static #p = 1; get x() { return this.#p } async *[k]() {} static { f() } }",
        "export default async () => { await 1 };\nimport a, { b as c } from 'x';\nexport * as d from \"y\"", "x = /[/]\\//g.test(y) / 2; if (/a/.test(b)) /c/.exec(d)", "a = `x${`y${z}`}w`; tag`q`", "switch (a) { case 1: case f(2) ? 1 : 2: b(); break; default: }",
        "label: for (;;) { continue label }", "do x++; while (x < 5) y()", "try { a() } catch { b() } finally { c() }", "var f = function () {}, { a, ...b } = c, g = x => ({ y: x })", "if (a) b(); else if (c) d(); else { e() }", "a\n++b", "new Foo, new Bar.Baz(1)[2]?.x?.(y)", "0x1F + 1_000n + .5e3", "#!/usr/bin/env node\nx()",
    ],
    "ts": [
        "interface A<T extends B = C> extends D<T> { readonly a: string; b?: number; [k: string]: any; m(x: T): void; new (x: T): A<T>; (y: 1 | 2): void }", "export async function f<T>(x: T, y?: string): Promise<Array<T>> { return x as any }", "type X = { a: 1 } & Partial<Y>[] | keyof Z | ((a: number) => string)",
        "enum E { A = 1, B, 'c' = 3 }", "abstract class A<T> implements B, C<T> { private readonly x: number = 1; constructor(public y: string) { super() } get z(): number { return 1 } declare w?: string; m?(): void }", "let x = <T,>(a: T): T => a; let v = y! as unknown as string", "declare module 'x' { export const a: number }", "namespace N { export type T = 1 }", "type C<T> = T extends string ? 1 : 2",
    ],
    "py": ["", "x: int = 1\n", "async def f(a, /, b=1, *c, d: int = 2, **e) -> None:\n    async with a as b, c: pass\n    return [x async for x in y if z]\n", "try:\n    x\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    y\nfinally:\n    z\n", "if a: b\nelif c:\n\td\nelse: e; f\n", "@d.e(1)\nclass A(B, metaclass=C):\n    'doc'\n    x = lambda a, *b: (yield a)\n", "match x:\n    case [1, *r] if r: pass\n", "a = b = c if d else e\nx[1:2, ::3] += (y := 5)\nprint(f'{a}', *b, **c)\n", "for i, (j, k) in x, y:\n    continue\nelse:\n    pass\n"],
    "json": ["{}", ' {"a": [1, -2.5e3, null, "\\u00e9"]} ', '"x"'],
    "yaml": ["", "a: 1\nb:\n- x\n- y: 2\n  z: 3\n", "x: 'it''s'\ny: {a: 1, b: [2, 3]} # c\n", "---\na\n---\n- b\n...\n", "? k\n: v\n", "a: b\n  c\n"],
}
BAD = {
    "js": ["const a", "if (a", "x = ", "foo(a b)", "<<<<<<< ours\na()\n=======\nb()\n>>>>>>> theirs\n", "<!DOCTYPE html><html></html>", "import os\n\ndef f(x):\n    return 1\n", "'abc", "`x${", "/* a", "const x: number = 1", "return 1", "a = 1 2", "}", "function () {}", "else {}", "let 1a = 2", "try {}", "{ a: 1, b: 2 }", "x = {a 1}", "for (a; b) c"],
    "ts": ["const a: = 1", "interface { a: string }", "let x: Array<string = 1", "export function f(a: any): {", "type X ="],
    "py": ["def f(:\n  pass", "if a\n    b", "x = (1,\n", "  a\nb", "def f():\nreturn 1", "print 'x'", "a = 1 2", "else:\n  x", "import {x} from y", "x = '''a", "@d\nx = 1", "try:\n    x\n", "class A\n", "<<<<<<< HEAD\nx\n", "f(a=1, =2)"],
    "json": ["", "{", '{"a": 1,}', "{'a': 1}", "[1 2]", '{"a": NaN}', "01", '{"a": 1} x', '{"a" 1}', '"a\nb"', "// c\n{}"],
    "yaml": ["a: b: c\n", "a: 1\nb\n", "a: 'x\n", "a: [1, 2\n", "\ta: 1\n", "a: 1\n  b: 2\n", "x: 1\n<<<<<<< ours\ny: 2\n", "a: 1\n>>>>>>> theirs\n", "a: @x\n", "- a\nb: c\n", "a: |\n  b: c\n d\n"],
}


@pytest.mark.parametrize("lang, text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(lang, text):
    assert fault(lang, text) == ""


@pytest.mark.parametrize("lang, text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(lang, text):
    assert fault(lang, text)


def _mutants(text, r, n):
    parts = re.findall(r"\w+|\n[ ]*|[ ]+|[^\w\s]", text)
    for _ in range(n):
        p, k = list(parts), r.randrange(len(parts))
        op = r.randrange(4)
        if op == 0:
            del p[k]
        elif op == 1:
            p.insert(k, r.choice(parts))
        elif op == 2:
            j = min(len(p) - 1, k + 1)
            p[k], p[j] = p[j], p[k]
        else:
            p = p[:k]
        yield "".join(p)


def test_mutants_agree_with_exact_parsers():
    r = random.Random(4)
    for base in GOOD["py"][2:]:
        for m in _mutants(base, r, 60):
            try:
                ast.parse(m)
            except (SyntaxError, ValueError):
                assert fault("py", m), m
    for m in _mutants('{"a": [1, {"b": null}, "c"], "d": {"e": -1.5}}', r, 200):
        try:
            json.loads(m)
            ok = True
        except ValueError:
            ok = False
        assert (fault("json", m) == "") == ok, m


def test_long_and_deep_texts():
    assert fault("js", "[" * 20000 + "]" * 20000) == ""
    assert fault("js", "a;" * 100_000) == ""
    assert fault("json", "[" * 50_000)
    assert fault("py", "x = 1\n" * 50_000) == ""


def test_operator(spark):
    rows = [
        (1, "r", "https://a/x.js", "const a"), (2, "r", "https://a/x.JS?v=1", "const a = 1"), (3, "r", "https://a/m.map (source map: ./s/y.py)", "def f(:"), (4, None, "https://a/z.json", None), (5, None, "https://a/z.json", ""),
        (6, "q", "https://a/.env", "<<<"), (7, "q", None, "x"), (8, "q", "https://a/x.py#f", ""), (9, "q", "https://a/c.yml", "a: b: c"), (10, "q", "https://a/b.py", "print(f'{x!r:>{w}}')\n"),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, url string, content string")
    assert sorted(r.file_id for r in S.invalid_files(df).collect()) == [1, 3, 5, 9]
    rates = {(r.repo, r.lang): (r.files, r.invalid) for r in S.invalid_rates(df).collect()}
    assert rates == {("r", "js"): (2, 1), ("r", "py"): (1, 1), (None, "json"): (1, 1), ("q", "py"): (2, 0), ("q", "yaml"): (1, 1)}
    assert S.invalid_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("lang, text", [
    ("js", "if(a)if(b)c();else d();else e()"), ("js", "if(a)b();else if(c)for(;;)if(d)e();else f()"), ("js", "do if(a)b();while(c)"), ("js", "do do a();while(b);while(c)"),
    ("js", "x={if(a){},else(b){}}"), ("js", "class A{if(a){}else(b){}}"), ("js", "x=>{a:1}"), ("ts", "type A = T extends (...a: any[]) => infer R ? R : never"),
    ("ts", "function f(cb: (e: Error) => void): void {}"), ("ts", "type M = { readonly [K in keyof T as X<K>]?: T[K] }"), ("ts", "type D = A extends B ? C extends D ? 1 : 2 : E extends F ? 3 : 4"),
    ("ts", "declare module 'x';"), ("ts", "declare module 'x' { const a: number, b: string; function f(x: A): B }"), ("ts", "let f = async (x: A) => ({ y: x })"), ("py", "match x:\n    case *y, 1: pass\n"),
])
def test_statements_and_types_that_nest(lang, text):
    assert fault(lang, text) == ""


@pytest.mark.parametrize("lang, text", [
    ("js", "if(a){}else{}else{}"), ("js", "if(a)b();c();else d()"), ("js", "while(a){}else{}"), ("js", "function f(){a();else{}}"), ("js", "switch(a){case 1:b();else c()}"),
    ("js", "x=>{a:1,b:2}"), ("js", "a();{ b: 1, c: 2 }"), ("ts", "type C = A extends B ? 1"), ("ts", "declare module 'x' { a b }"), ("ts", "const a: number"), ("py", "match x:\n    case *[1]: pass\n"),
])
def test_lost_branches_and_literals_are_flagged(lang, text):
    assert fault(lang, text)


FLOW = [
    "a: [1, 2, ]", "a: {b: c, d, ? e : f, g: , }", "a: [x: y, \"k\":v, {m: [n]}: o]", "a: [p\n  q, 'r\n  s'] # c", "a: {p\n  q: r}", "a: {{ x }}", "[]: {}", "a: [&x b, *x , !t c, !!str 'd', http://e:1/f#g, -1, a - b ? c]", "- {a: b}\n- [c]", "a: [\n  b, # c\n  d\n  ]",
]
NO_FLOW = ["a: [1, , 2]", "a: {b: c: d}", "a: {x: \"p\" \"q\"}", "a: [,]", "a: [- b]", "a: [b\n  c: d]", "a: {b: [c}]", "a: [@b]", "a: {b: \"\\q\"}", "a: [*x y]", "a: [b # c\n  d]"]
FIELDS = ["f'{a!r:>{w}}' f'{{x}}'", "f'{a[\"b\"]}' 'c'", "f'{x[1:2]} {y:%H:%M} {z=} {z = !s:^5}'", "rf'\\{x}' + f'\\N{BULLET}{y}'", 'f"""{\n a\n}\n{f\'{b}\'}"""', "f'{(lambda x: 1)}{yield_ if a else b}{*c, d}'", "f'{a != b}{c:{d}{e}}{f\'{g}\'}'", "f'{x:{{1}}}'"]
NO_FIELDS = ["f'{a b}'", "f'{'", "f'{}'", "f'}'", "f'{a!x}'", "f'{a:{b c}}'", "f'{a'", "f'{a + }'", "f'{lambda x: 1}'", "f'{a:{}}'", "f'{f\"{b c}\"}'"]


@pytest.mark.parametrize("text", FLOW)
def test_yaml_flow_contents_that_fit(text):
    assert fault("yaml", text + "\n") == ""


@pytest.mark.parametrize("text", NO_FLOW)
def test_yaml_flow_contents_that_do_not_fit(text):
    assert fault("yaml", text + "\n")


@pytest.mark.parametrize("text", FIELDS + NO_FIELDS)
def test_fields_of_formatted_strings_against_ast(text):
    try:
        ast.parse("x = " + text)
        ok = True
    except SyntaxError:
        ok = False
    assert ok == (text in FIELDS)
    assert (fault("py", "x = " + text + "\n") == "") == ok


def test_python_verdict_is_the_method_own(spark):
    assert "ast" not in vars(S)
    r = random.Random(11)
    texts = [m for base in GOOD["py"][2:] for m in _mutants(base, r, 25)]
    df = spark.createDataFrame([(i, "https://a/x.py", t) for i, t in enumerate(texts)], "file_id bigint, url string, content string")
    flagged = {x.file_id for x in S.invalid_files(df).collect()}
    assert flagged == {i for i, t in enumerate(texts) if fault("py", t)}
