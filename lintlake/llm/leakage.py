"""Evaluation passages in training text, by the q-gram lemma.

Texts become streams of words (letters and digits of the consistent form, letter case folded) joined by one space. A
passage of ``min_words`` words that stands in a document with at most ``edits`` character edits shares at least
``length + 1 - q - edits * q`` q-grams with it inside one band of diagonals; q is at most ``Q`` and such that this is 1
or more for every passage. Shared q-grams are counted per document, item and overlapping band; bands that meet the
bound are verified by banded alignment of whole words. With no edits allowed a band is one diagonal, and its alignment
is the run of equal characters along it.

The items' q-gram index is broadcast. Its size is checked: items are cut into blocks of at most ``BLOCK_CHARS``
characters, and each block makes one pass over the documents. Null and empty texts hold nothing; an item of fewer
words than ``min_words`` can't leak.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.canonical import canonical

MIN_WORDS = 12
Q = 16
#: Characters of items in one broadcast index; it takes about 40 bytes for each.
BLOCK_CHARS = 1_000_000
#: Characters of documents that are hashed together in a task.
BATCH_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_TABLE_BITS = 22


def words_of(text: str | None) -> list[str]:
    """Words of the consistent form, case folded."""
    return _WORD.findall(canonical(text).casefold()) if text else []


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Polynomial hashes of all q-grams, mixed."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h *= _BASE
        h += codes[i : i + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Index:
    """Sorted q-gram hashes of the items with their places; bits of a table say which hashes may occur."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    ids: list
    texts: list[str]
    bound: np.ndarray
    q: int


def build_index(items: list[tuple[object, str | None]], min_words: int = MIN_WORDS, edits: int = 0) -> Index | None:
    ids, texts, shortest = [], [], []
    for i, text in items:
        words = words_of(text)
        if len(words) < min_words:
            continue
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = ends - np.array([len(w) + 1 for w in words])
        shortest.append(int((ends[min_words - 1 :] - 1 - starts[: len(words) - min_words + 1]).min()))
        ids.append(i)
        texts.append(" ".join(words))
    if not ids:
        return None
    q = max(1, min(Q, min(shortest) // (edits + 1)))
    hs = [_grams(_codes(x), q) for x in texts]
    its = [np.full(len(h), k, np.int32) for k, h in enumerate(hs)]
    pls = [np.arange(len(h), dtype=np.int32) for h in hs]
    bound = [max(1, n + 1 - q - edits * q) for n in shortest]
    h, it, pl = np.concatenate(hs), np.concatenate(its), np.concatenate(pls)
    order = np.argsort(h, kind="stable")
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return Index(h[order], it[order], pl[order], table, ids, texts, np.array(bound), q)


def _longest_word_run(a: str, b: str, shift: int, min_words: int) -> bool:
    """Whether, on diagonal ``shift`` (place in a minus place in b), equal characters span ``min_words`` whole words."""
    lo = max(0, -shift)
    hi = min(len(b), len(a) - shift)
    if hi <= lo:
        return False
    x = np.frombuffer(a[lo + shift : hi + shift].encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(b[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(x != y)
    at = 0
    for stop in [*breaks.tolist(), hi - lo]:
        s, e = at + lo, stop + lo  # equal run b[s:e], a[s+shift:e+shift]
        at = stop + 1
        if e - s < 2 * min_words - 1:
            continue
        run = b[s:e]
        first = (s == 0 or b[s - 1] == " ") and (s + shift == 0 or a[s + shift - 1] == " ")
        last = (e == len(b) or b[e] == " ") and (e + shift == len(a) or a[e + shift] == " ")
        parts = run.split(" ")
        n = len(parts) - (not first) - (not last)
        if not parts[0] and first:
            n -= 1
        if len(parts) > 1 and not parts[-1] and last:
            n -= 1
        if n >= min_words:
            return True
    return False


def _banded(a: str, b: str, low: int, high: int, edits: int, min_words: int) -> bool:
    """Whether some ``min_words`` words of b stand in a with at most ``edits`` edits, on the diagonals low to high.

    A diagonal is place in a minus place in b; the band reaches ``edits`` further on both sides, since an edit may
    leave it and come back. The spaces around a passage belong to it, so that words count as wholes.
    """
    words = b.split(" ")
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])[:-1].tolist()
    a, b = f" {a} ", f" {b} "
    low, width, n = low - edits, high - low + 1 + 2 * edits, len(a)
    for k in range(len(words) - min_words + 1):
        s, last = starts[k], k + min_words - 1
        prev = [0] * width  # a passage may begin on any diagonal
        for i in range(s, starts[last] + len(words[last]) + 2):
            ch, at, cur = b[i], i + low, []
            for j in range(width):
                v = prev[j] + (not (0 <= at + j < n and a[at + j] == ch))
                if j + 1 < width and prev[j + 1] + 1 < v:
                    v = prev[j + 1] + 1
                if j and cur[j - 1] + 1 < v:
                    v = cur[j - 1] + 1
                cur.append(v)
            prev = cur
            if min(cur) > edits:
                break
        else:
            return True
    return False


#: Shared q-grams that are held at once while they are counted.
PART = 4_000_000


def _counted(ix: Index, h: np.ndarray, maybe: np.ndarray, start: np.ndarray, width: int, offset: int) -> tuple[np.ndarray, ...]:
    """(document, item, band, shared q-grams), counted part by part so that boilerplate in many items fits as well."""
    left, right = np.searchsorted(ix.hashes, h[maybe], "left"), np.searchsorted(ix.hashes, h[maybe], "right")
    n = right - left
    keep = n > 0
    maybe, left, n = maybe[keep], left[keep], n[keep]
    keys, counts = np.empty((0, 3), np.int64), np.empty(0, np.int64)
    total = np.cumsum(n)
    at = 0
    while at < len(maybe):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PART, "right")))
        m, le, c = maybe[at:stop], left[at:stop], n[at:stop]
        flat = np.repeat(le - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
        place = np.repeat(m, c)
        doc = np.searchsorted(start, place, "right") - 1
        band = ((place - start[doc]) - ix.place[flat] + offset) // width
        keys = np.concatenate([keys, np.stack([doc, ix.item[flat], band], 1)])
        counts = np.concatenate([counts, np.ones(len(flat), np.int64)])
        order = np.lexsort(keys.T[::-1])
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        keys, counts = keys[new], np.add.reduceat(counts, new)
        at = stop
    return keys[:, 0], keys[:, 1], keys[:, 2], counts


def _search(ix: Index, ids: list, texts: list[str], min_words: int, edits: int) -> list[tuple]:
    """(document id, item id) found in a batch of word streams."""
    starts, at, pieces = [], 0, []
    for t in texts:
        starts.append(at)
        pieces.append(t)
        at += len(t) + 1
    start = np.array(starts, dtype=np.int64)
    codes = _codes("\n".join(pieces))  # no item holds a line break, so no q-gram spans two documents
    h = _grams(codes, ix.q)
    maybe = np.flatnonzero(ix.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    if not len(maybe):
        return []
    width = 1 if edits == 0 else 1 << int(np.ceil(np.log2(2 * edits + 1)))
    found: set[tuple[int, int]] = set()
    for offset in (0,) if edits == 0 else (0, width // 2):
        doc, item, band, count = _counted(ix, h, maybe, start, width, offset)
        for k in np.flatnonzero(count >= ix.bound[item]).tolist():
            pair = (int(doc[k]), int(item[k]))
            if pair in found:
                continue
            low = int(band[k]) * width - offset
            if edits == 0:
                good = _longest_word_run(texts[pair[0]], ix.texts[pair[1]], low, min_words)
            else:
                good = _banded(texts[pair[0]], ix.texts[pair[1]], low, low + width - 1, edits, min_words)
            if good:
                found.add(pair)
    return [(ids[a], ix.ids[b]) for a, b in found]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, read through the driver block by block."""
    block, size = [], 0
    for r in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col).toLocalIterator():
        if block and size + len(r[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    min_words: int = MIN_WORDS,
    edits: int = 0,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id): one row per document and item with ``min_words`` consecutive words in common."""
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"{doc_id} {kinds[0]}, {item_id} {kinds[1]}"
    result = None
    for block in _blocks(items, item_id, text_col):
        index = build_index(block, min_words, edits)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ix = shared.value
            for b in batches:
                ids, texts, size, out = [], [], 0, []
                for i, t in zip(b[doc_id], b[text_col]):
                    stream = " ".join(words_of(t))
                    if len(stream) < 2 * min_words - 1:
                        continue
                    ids.append(i)
                    texts.append(stream)
                    size += len(stream)
                    if size > BATCH_CHARS:
                        out += _search(ix, ids, texts, min_words, edits)
                        ids, texts, size = [], [], 0
                if ids:
                    out += _search(ix, ids, texts, min_words, edits)
                yield pd.DataFrame(out, columns=[doc_id, item_id])

        part = docs.select(doc_id, text_col).where(F.col(text_col).isNotNull()).mapInPandas(run, schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return docs.select(F.col(doc_id), F.lit(None).cast(kinds[1]).alias(item_id)).limit(0)
    return result
