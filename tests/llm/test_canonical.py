import itertools
import unicodedata

import pytest

from lintlake.llm import canonical as C

SAME = [
    ("admin page", "аdmin page"), ("Token", "Ｔｏｋｅｎ"), ("café", "cafe\u0301"), ("a b", "a\u00a0b"), ("a b", "a\u3000b"), ("secret", "se\u200bcret"), ("secret", "se\u00adcret\ufeff"), ("file", "\ufb01le"),
    ("Ё", "Е\u0308"), ("ό", "ο\u0301"), ("ΑΒ", "AB"), ("e\u200d\u0301", "é"), ("x²", "x2"), ("a\r\nb", "a\nb"), ("\uac00", "\u1100\u1161"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("o", "ö"), ("1", "4"), (".", "!"), ("a b", "a  b"), ("a\nb", "a b"), ("и", "й"), ("l", "1"), ("O", "0"), ("-", "–"), ("", " "), ("a\tb", "a b"), ("'", "’")]


@pytest.mark.parametrize("a, b", SAME)
def test_looks_the_same(a, b):
    assert C.canonical(a) == C.canonical(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_visible_differences_stay(a, b):
    assert C.canonical(a) != C.canonical(b)


def test_idempotent_over_all_code_points():
    for o in itertools.chain(range(0x3000), range(0xA000, 0xB000), range(0xF900, 0x10000), range(0x1D400, 0x1D800)):
        ch = chr(o)
        if unicodedata.category(ch) in ("Cn", "Cs", "Co"):
            continue
        once = C.canonical(f"x{ch}y")
        assert C.canonical(once) == once, hex(o)


def test_long_runs_of_marks():
    assert len(C.canonical("e" + "\u0301" * 100_000)) <= 100_001


def _pairs(spark, rows, **k):
    return {tuple(r) for r in C.look_alike_pairs(spark.createDataFrame(rows, "doc_id bigint, text string"), **k).collect()}


def test_pairs(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "ａbc"), (5, "abd"), (6, None), (7, ""), (8, "\u200b"), (9, " "), (10, "\u00a0")]
    assert _pairs(spark, rows) == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert _pairs(spark, []) == set()


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_classes_of_any_size_give_all_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(C, "HOT_SHARE", share)
    rows = [(i, "abc" if i % 2 else "аbc") for i in range(60)] + [(100, "x y"), (101, "x\u00a0y"), (102, "x y"), (103, "alone"), (104, "alone"), (105, None)]
    got = _pairs(spark, rows)
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and x != y and C.canonical(x) == C.canonical(y)}
    assert got == want and len(got) == 900 + 2
    classes = {r.doc_id: (r.class_id, r.spelling_id, r.spellings, r.documents) for r in C.look_alike_membership(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert classes[7] == (0, 1, 2, 60) and classes[8] == (0, 0, 2, 60) and classes[101] == (100, 101, 2, 3) and classes[104] == (103, 103, 1, 2) and 105 not in classes


def test_mapping_is_made_before_use_and_checked():
    table = C.mapping()
    assert len(table) > 5000 and table[ord("Ａ")] == "A" and table[ord("ꓮ")] == "A" and table[0x200B] == ""
    for bad in ({ord("x"): "y"}, {ord("б"): "Ａ", ord("Ａ"): "A"}):
        with pytest.raises(ValueError):
            C.check_conflicts(bad)


def test_conflicting_letters_of_one_alphabet(monkeypatch):
    monkeypatch.setitem(C.LOOK_ALIKES, "б", "a")
    with pytest.raises(ValueError):
        C.check_conflicts({})


def test_extra_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "abc"), (2, "аbc")], "doc_id bigint, text string").withColumns({"form": F.lit(1), "spelling": F.lit("x"), "a": F.lit(2)})
    assert C.look_alike_pairs(df).count() == 1
    assert [r.canonical for r in C.canonical_texts(df).collect()] == ["abc", "abc"]


def test_plain_ascii_takes_the_short_way_to_the_same_form():
    table, _, _ = C._compiled()
    for o in range(128):
        text = f"a{chr(o)}b\r\n"
        assert C.canonical(text) == (f"a{chr(o)}b\n").translate(table)


def test_spans_give_the_form_of_the_whole_text():
    import random

    r = random.Random(4)
    pool = "ab \n\t.éÉＡａ\u0301\u200b\u00a0аꓮ\x01\x7f한\u1100\u1161ﬁ漢😀\u200d\ufe0f"
    for _ in range(3000):
        text = "".join(r.choices(pool, k=r.randint(0, 60)))
        assert C.canonical(text) == C._transduce(text)
