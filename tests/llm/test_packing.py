import os
import random

import pytest

from lintlake.llm import packing as K


@pytest.fixture(scope="module")
def placed(spark):
    if not os.path.exists(K.TOKENIZER):
        pytest.skip("no tokenizer here")
    r = random.Random(5)
    words = "river stone bridge garden copper silver window forest harbor meadow".split()
    docs = [(i, " ".join(r.choices(words, k=r.choice([3, 20, 60, 90, 130, 400])))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "word " * 3000), (1003, "a")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 100), ("m", 512)], "container_kind string, capacity_tokens int")
    rows = K.containers(df, sizes, shard_docs=150).collect()
    tokens = {r.doc_id: r.tokens for r in K.sized(df).collect()}
    return rows, tokens


def test_rules(placed):
    rows, tokens = placed
    for kind, capacity in (("s", 100), ("m", 512)):
        mine = [r for r in rows if r.container_kind == kind]
        used = {}
        for r in mine:
            used[r.container_id] = used.get(r.container_id, 0) + r.tokens
        assert all(r.container_id for r in mine) and max(used.values()) <= capacity
        pieces = {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.tokens))
        assert set(pieces) == set(tokens)
        for d, p in pieces.items():
            p.sort()
            assert sum(x[2] for x in p) == tokens[d]
            assert [x[1] for x in p] == [sum(y[2] for y in p[:i]) for i in range(len(p))]
            assert len(p) == max(1, -(-tokens[d] // capacity))
        assert sum(used.values()) / (len(used) * capacity) > 0.93


def test_neighbours_are_ranked_by_shared_rare_terms():
    import numpy as np

    terms = [np.array(x) for x in ([1, 2, 9], [1, 2], [9], [3, 4])]
    idf = np.zeros(10, np.float32)
    idf[[1, 2, 3, 4]] = 2.0
    idf[9] = 0.1
    shard = K.Shard(np.array([5, 5, 5, 5]), terms, [np.ones(len(t), int) for t in terms], idf, 2.0)
    assert shard.neighbours(0, np.array([True] * 4)).tolist() == [1, 2]


def test_empty_table(spark):
    if not os.path.exists(K.TOKENIZER):
        pytest.skip("no tokenizer here")
    df = spark.createDataFrame([], "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 100)], "container_kind string, capacity_tokens int")
    assert K.containers(df, sizes).count() == 0


def test_neighbours_come_before_size():
    import numpy as np

    terms = [np.array(x) for x in ([1, 2], [1], [3], [2])]
    idf = np.zeros(10, np.float32)
    idf[[1, 2, 3]] = 1.0
    shard = K.Shard(np.array([50, 20, 40, 10]), terms, [np.ones(len(t), int) for t in terms], idf, 2.0)
    assert sorted(map(sorted, shard.fill(90))) == [[0, 1, 3], [2]]


def test_shards_are_bounded_by_terms(spark, monkeypatch):
    if not os.path.exists(K.TOKENIZER):
        pytest.skip("no tokenizer here")
    monkeypatch.setattr(K, "SHARD_TERMS", 200)
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(30)], "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 400)], "container_kind string, capacity_tokens int")
    rows = K.containers(df, sizes).collect()
    assert len({r.doc_id for r in rows}) == 30 and all(r.container_id for r in rows)
    shared = {r.container_kind: r.shared for r in K.relatedness(spark.createDataFrame(rows), K.sized(df)).collect()}
    assert 0 <= shared.get("s", 0) < 0.5
