import random

from lintlake.llm import leakage as L


def _brute(docs, items, n):
    out = set()
    grams = [(i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) for i, w in ((i, L.words_of(t)) for i, t in items)]
    for d, t in docs:
        w = L.words_of(t)
        mine = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(d, i) for i, g in grams if g & mine}
    return out


def _run(spark, docs, items, **k):
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rows = L.leaked_items(d, i, **k).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def test_random_passages_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BATCH_CHARS", 3000)
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["a", "b", "I"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(5, 60)))) for i in range(40)]
    docs = []
    for d in range(300):
        words = r.choices(vocabulary, k=r.randint(0, 80))
        if r.random() < 0.6:
            w = items[r.randrange(40)][1].split()
            s = r.randrange(len(w))
            piece = w[s : s + r.randint(9, 16)]
            at = r.randint(0, len(words))
            words[at:at] = piece
        docs.append((d, r.choice([" ", ", ", "\n// ", ' "'.join(["", ""])]).join(words)))
    docs += [(900, None), (901, ""), (902, items[0][1])]
    want = _brute(docs, items, 12)
    assert _run(spark, docs, items + [(99, None), (98, "")]) == want and len(want) > 20
    monkeypatch.setattr(L, "BLOCK_CHARS", 500)  # several blocks of items
    assert _run(spark, docs, items) == want


def test_spelling_is_ignored(spark):
    item = "Explain in two steps why the session only exposes a remote sandbox after reconnect today"
    variants = ["> " + item.upper().replace(" ", "\n> "), "/* " + item.replace("e", "е") + " */", "“" + item.replace(" ", "\u00a0") + "”", item.replace("session", "ses\u00adsion"), item.replace("session only", "session also only")]
    assert _run(spark, list(enumerate(variants)), [(1, item)]) == {(0, 1), (1, 1), (2, 1), (3, 1)}


def test_edits_within_budget(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(0, "x y " + item.replace("seven", "sevem") + " z"), (1, item.replace("seven", "sXXXXn")), (2, "nothing of it")]
    got = _run(spark, docs, [(1, item)], edits=1)
    assert (0, 1) in got and (2, 1) not in got


def test_empty_tables(spark):
    assert _run(spark, [], [(1, "a " * 20)]) == set()
    assert _run(spark, [(1, "a " * 20)], []) == set()


def _near(doc, item, n, edits):
    """Whether n words of the item stand in the document within the edits, by a full table."""
    w = L.words_of(item)
    a = f" {' '.join(L.words_of(doc))} "
    for k in range(len(w) - n + 1):
        p = f" {' '.join(w[k : k + n])} "
        row = [0] * (len(a) + 1)
        for ch in p:
            new = [row[0] + 1]
            for j, x in enumerate(a):
                new.append(min(row[j] + (x != ch), row[j + 1] + 1, new[j] + 1))
            row = new
        if min(row) <= edits:
            return True
    return False


def test_edits_against_the_full_table(spark, monkeypatch):
    monkeypatch.setattr(L, "PART", 50)
    r = random.Random(8)
    vocabulary = ["tap", "trace", "of", "a", "index", "I", "signal", "by", "row"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(4, 9)))) for i in range(12)]
    docs = []
    for d in range(60):
        s = list(" ".join(r.choices(vocabulary, k=3)) + " " + r.choice(items)[1] + " " + r.choice(vocabulary))
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice([[], [r.choice("xyz")], [s[k], r.choice("ab ")]])
        docs.append((d, "".join(s)))
    for edits in (0, 1, 2):
        got = _run(spark, docs, items, min_words=4, edits=edits)
        assert got == {(d, i) for d, t in docs for i, u in items if _near(t, u, 4, edits)} and len(got) > 15


def test_one_edit_more_than_allowed_is_refused(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november".split()
    bad = [w if k % 2 else w[:-1] + "zz" for k, w in enumerate(words)]
    assert _run(spark, [(1, " ".join(bad))], [(1, " ".join(words))], edits=1) == set()
