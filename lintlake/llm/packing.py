"""Filling containers of fixed capacity with documents, related ones together.

Sizes are tokens of a public byte-level tokenizer whose file is a parameter. Documents are spread over shards of a
bounded number of documents and terms by a hash of their id, so a hot source is no hot shard. Each shard holds a BM25 inverted
index of its documents with corpus-wide document frequencies (terms hashed to 2^18 buckets, so the frequencies are one
vector of fixed size, whatever the corpus). The largest unused document is the seed of a container; the index returns
its unused neighbours by score, which fill the window greedily in that order; what room no neighbour fits into is closed by
the one or two unused items that fit it best. Containers left with room are dissolved once and their items packed again in wider shards.

A document larger than the capacity is the only kind that is split: into full containers and a rest, which is an
item like any other. Null and empty texts have no tokens; they are items of size 0 and stand in the first container
of their shard. Every document has a place for every capacity.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.canonical import canonical
from lintlake.sources.tables import cut

#: Vocabulary file of the tokenizer, unless one is named.
TOKENIZER = os.environ.get("LINTLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the tokenizer's vocabulary cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents, and distinct terms of documents, in a shard at most, on average.
SHARD_DOCS = 3000
SHARD_TERMS = 1_000_000
TERM_BITS = 18
K1, B = 1.2, 0.75
#: A container filled to a smaller share than this is dissolved once and packed again.
FULL = 0.97
_WORD = re.compile(r"[^\W_]+")


@lru_cache(4)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(500_000)
def _bucket(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - TERM_BITS)


def sized(docs: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, terms, counts): size of every document, its hashed terms and how often each stands in it."""
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, about 1 MB
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(shared.value)
        for b in batches:
            rows = []
            for i, text in zip(b[doc_id], b[text_col]):
                text = text or ""
                size = len(enc.encode_ordinary(text))
                found = np.array([_bucket(w) for w in _WORD.findall(canonical(text).casefold())], np.int32)
                terms, counts = np.unique(found, return_counts=True)
                rows.append((i, size, terms.astype(np.int32), counts.astype(np.int32)))
            yield pd.DataFrame(rows, columns=[doc_id, "tokens", "terms", "counts"])

    return docs.select(doc_id, text_col).mapInPandas(run, f"{doc_id} {kind}, tokens int, terms array<int>, counts array<int>")


def document_frequencies(items: DataFrame) -> np.ndarray:
    """Documents of each term bucket, over all documents; each task reduces to one vector before anything is moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << TERM_BITS, np.int64)
        for b in batches:
            for t in b["terms"]:
                total[np.asarray(t, np.int64)] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at.astype(np.int32), "n": total[at]})

    out = np.zeros(1 << TERM_BITS, np.int64)
    summed = items.select("terms").mapInPandas(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[summed["term"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


class Shard:
    """The inverted index of some items and the greedy filling of containers from it."""

    def __init__(self, sizes: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean: float):
        self.sizes, self.alive = sizes, np.ones(len(sizes), bool)
        n = len(sizes)
        lengths = np.array([c.sum() if len(c) else 0 for c in counts], float)
        norm = K1 * (1 - B + B * lengths / max(mean, 1.0))
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
        flat = np.concatenate(terms) if n else np.empty(0, np.int64)
        tf = np.concatenate(counts).astype(np.float32) if n else np.empty(0, np.float32)
        weight = (idf[flat] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        keep = idf[flat] > 0  # terms of more than half of all documents say nothing
        owner, flat, weight = owner[keep], flat[keep], weight[keep]
        order = np.argsort(flat, kind="stable")
        self.vocabulary, starts = np.unique(flat[order], return_index=True)
        self.post, self.weight = owner[order], weight[order]
        self.starts = np.append(starts, len(flat))
        self.live = self.post, self.weight, self.starts
        self.terms = terms

    def neighbours(self, seed: int, free: np.ndarray, room: int | None = None) -> np.ndarray:
        """Free items of at most ``room`` that share a term with the seed, by falling BM25 score, then by place."""
        mine = self.terms[seed]
        at = np.searchsorted(self.vocabulary, mine)
        ok = at < len(self.vocabulary)
        at, mine = at[ok], mine[ok]
        at = at[self.vocabulary[at] == mine]
        post, weight, starts = self.live
        s, n = starts[at], starts[at + 1] - starts[at]
        if not n.any():
            return np.empty(0, np.int64)
        place = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        owner = post[place]
        fits = free if room is None else free & (self.sizes <= room)
        live = fits[owner]
        score = np.bincount(owner[live], weight[place[live]], len(self.sizes))
        score[seed] = 0
        hit = np.flatnonzero(score > 0)
        return hit[np.argsort(-score[hit], kind="stable")]

    def compact(self, free: np.ndarray) -> None:
        """Leaves the postings of free items alone, so that a seed does not walk those of used ones."""
        post, weight, starts = self.live
        kept = free[post]
        before = np.concatenate([[0], np.cumsum(kept)])
        self.live = post[kept], weight[kept], before[starts]

    def fill(self, capacity: int) -> list[list[int]]:
        """Containers as lists of items, none above ``capacity``."""
        sizes = self.sizes
        free = self.alive.copy()
        self.live = self.post, self.weight, self.starts
        indexed = len(free)
        order = np.argsort(-sizes, kind="stable")
        order = order[free[order]]
        by_size: dict[int, list[int]] = {}
        for k in order[::-1].tolist():
            by_size.setdefault(int(sizes[k]), []).append(k)
        left = np.zeros(capacity + 1, np.int64)
        for s, ks in by_size.items():
            left[s] = len(ks)

        def take(k: int) -> None:
            free[k] = False
            left[sizes[k]] -= 1

        def some(size: int) -> int:
            ks = by_size[size]
            while not free[ks[-1]]:
                ks.pop()
            return ks[-1]

        out: list[list[int]] = []
        for seed in order.tolist():
            if not free[seed]:
                continue
            if sizes[seed] == 0:
                if not out:
                    out.append([])
                take(seed)
                out[0].append(seed)
                continue
            take(seed)
            box, room = [seed], capacity - int(sizes[seed])
            unused = int(left.sum())
            if unused < indexed * 0.7:
                self.compact(free)
                indexed = unused
            # unused neighbours fill the window greedily by falling score
            near = self.neighbours(seed, free, room) if left[1 : room + 1].any() else np.empty(0, np.int64)
            for k in near.tolist():
                size = int(sizes[k])
                if 0 < size <= room:
                    take(k)
                    box.append(k)
                    room -= size
                    if not room:
                        break
            # what no neighbour fits into is closed by size
            while room > 0:
                have = np.flatnonzero(left[: room + 1])
                have = have[have > 0]
                if not len(have):
                    break
                one = int(have[-1])
                best = (one, 0)
                if one < room:  # two items may close the gap better than one
                    rest = np.searchsorted(have, room - have, "right") - 1
                    ok = rest >= 0
                    if ok.any():
                        total = have[ok] + have[rest[ok]]
                        for j in np.argsort(-total, kind="stable")[:4].tolist():
                            a, b = int(have[ok][j]), int(have[rest[ok][j]])
                            if total[j] > one and (a != b or left[a] > 1):
                                best = (a, b)
                                break
                for s in best:
                    if s:
                        k = some(s)
                        take(k)
                        box.append(k)
                        room -= s
            out.append(box)
        return out


def _pack(rows: pd.DataFrame, kinds: list[tuple[str, int]], idf: np.ndarray, mean: float, shard: int, level: int, last: bool) -> pd.DataFrame:
    """Rows (kind, container, doc_id, piece, start, tokens) of one shard; unfilled containers carry no id unless ``last``."""
    out = []
    terms = [np.asarray(t, np.int64) for t in rows["terms"]]
    counts = [np.asarray(c, np.int64) for c in rows["counts"]]
    ids, tokens = rows["doc_id"].to_numpy(), rows["tokens"].to_numpy(np.int64)
    index = Shard(tokens, terms, counts, idf, mean)
    for kind, capacity in kinds:
        mine = ((rows["container_kind"] == kind) if level else pd.Series(True, rows.index)).to_numpy()
        offset = rows["start"].to_numpy(np.int64) if level else np.zeros(len(rows), np.int64)
        piece = rows["piece"].to_numpy(np.int64) if level else np.zeros(len(rows), np.int64)
        whole = np.zeros(len(rows), np.int64) if level else tokens // capacity
        for j in np.flatnonzero(whole).tolist():
            for p in range(int(whole[j])):
                out.append((kind, f"{kind}-{level}-{shard}-{ids[j]}-{p}", ids[j], p, p * capacity, capacity))
        index.sizes = tokens - whole * capacity
        index.alive = mine & ((index.sizes > 0) | (tokens == 0))
        for c, box in enumerate(index.fill(capacity)):
            total = int(index.sizes[box].sum())
            name = f"{kind}-{level}-{shard}-c{c}" if last or total >= FULL * capacity else None
            for j in box:
                out.append((kind, name, ids[j], int(piece[j] + whole[j]), int(offset[j] + whole[j] * capacity), int(index.sizes[j])))
    return pd.DataFrame(out, columns=["container_kind", "container_id", "doc_id", "piece", "start", "tokens"])


def containers(docs: DataFrame, sizes: DataFrame, tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, start_token, tokens): a place for every document and capacity."""
    spark = docs.sparkSession
    kinds = [(r.container_kind, int(r.capacity_tokens)) for r in sizes.orderBy("container_kind").collect()]
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    items = cut(sized(docs, tokenizer))
    total = items.agg(F.count(F.lit(1)).alias("n"), F.avg(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("m"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("t")).first()
    n, mean = total.n, float(total.m or 1.0)
    shards = max(1, math.ceil(n / shard_docs), math.ceil(total.t / SHARD_TERMS))
    df = document_frequencies(items)
    idf = np.where((df > 0) & (df <= max(1, n / 2)), np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)  # 2^18 numbers
    schema = f"container_kind string, container_id string, doc_id {id_kind}, piece int, start int, tokens int"

    def level(frame: DataFrame, number: int, shards: int, last: bool) -> DataFrame:
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "piece"] if number else ["doc_id"], kind="stable").reset_index(drop=True)
            return _pack(rows, kinds, shared.value, mean, int(key[0]), number, last)

        keyed = frame.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
        return keyed.groupBy("shard").applyInPandas(run, schema)

    first = cut(level(items, 0, shards, False))
    open_ = first.where("container_id is null")
    again = open_.select("container_kind", "doc_id", "piece", "start", "tokens").join(items.select("doc_id", "terms", "counts"), "doc_id")
    count = open_.count()
    second = level(again, 1, max(1, math.ceil(count / (4 * shard_docs))), True)
    return (
        first.where("container_id is not null").unionByName(second).withColumnRenamed("start", "start_token")
    )


def relatedness(placed: DataFrame, items: DataFrame) -> DataFrame:
    """(container_kind, shared): mean share of a member's terms that its container's largest member has as well."""
    own = placed.join(items.select("doc_id", "terms"), "doc_id").where(F.size("terms") > 0)
    seed = own.groupBy("container_kind", "container_id").agg(F.max(F.struct("tokens", "doc_id", "piece")).alias("s"))
    line = own.join(seed.select("container_kind", "container_id", "s"), ["container_kind", "container_id"])
    heads = line.where(F.struct("tokens", "doc_id", "piece") == F.col("s")).select("container_kind", "container_id", F.col("terms").alias("head"))
    rest = line.where(F.struct("tokens", "doc_id", "piece") != F.col("s")).join(heads, ["container_kind", "container_id"])
    return rest.groupBy("container_kind").agg(F.avg(F.size(F.array_intersect("terms", "head")) / F.size("terms")).alias("shared"))


def fill_report(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, room_left, fill) of a packing."""
    per = placed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("used"))
    return per.join(sizes, "container_kind").groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.sum(F.col("capacity_tokens") - F.col("used")).alias("room_left"),
        (F.sum("used") / F.sum("capacity_tokens")).alias("fill"),
    )
