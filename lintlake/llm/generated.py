"""Generated, minified and vendored files, and data saved as code.

Each code file is turned into token classes (names, strings and numbers as one class each, words of the language and
punctuation as they are) and a Re-Pair grammar is inferred over them: pairs of neighbours that occur most are replaced
by a rule until none occurs three times. From it:

* rule reuse: the share of the file that one rule's uses expand to, and the grammar's size against the file's. Output
  of generators is one long rule used over and over.
* minified code reuses rules in code without white space and with names of a letter or two.
* blobs: literals fill the file and are near-incompressible by themselves, or numbers do.
* vendoring: one Re-Pair grammar is inferred over the exact tokens of a library and of the file together; a copy,
  whole, cut or lightly changed, is mostly made of long rules that both sides use. Windows of ``PHRASE`` tokens that
  both have say which library a file is held against, if any.

The content decides, never the path or the recovered flag. One narrow pass; library indexes are broadcast in blocks
of bounded size, and a file's verdict does not depend on how the libraries are cut into blocks, since each library is
judged by itself. Null contents are no case, nor are empty files, web pages and other extensions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.syntax import extension

CODE = ("js", "mjs", "ts", "py")
#: Exact tokens in a phrase that a library and a file may share.
PHRASE = 8
#: Characters of libraries in one broadcast index (about 15 bytes for each).
BLOCK_CHARS = 4_000_000
#: A pair is replaced while it occurs so often.
LEAST_USES = 3
#: Share of a file's tokens in windows of a library from which both are put into one grammar.
CANDIDATE = 0.3
#: Share of a file's tokens in rules that it shares with a library from which it is a copy.
COPY = 0.6

_STRING = r"(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*+(?:\"|$)|'(?:[^'\\\n]|\\[\s\S])*+(?:'|$)|`[^`]*+(?:`|\Z))"
_REST = r"(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<punct>[^\s\w])"
_TOKENS = {
    True: re.compile(rf"(?P<long>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))|{_STRING}|(?P<comment>#[^\n]*)|{_REST}", re.M),
    False: re.compile(rf"{_STRING}|(?P<comment>/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*)|{_REST}", re.M),
}
# Words of the languages, which stay themselves among token classes.
KEYWORDS = frozenset(
    "import from export const let var function return if else for of in while do switch case try catch finally throw new await async class extends def "
    "lambda with as None True False null void true false type interface default module except pass raise print self this static get set and or not is".split()
)
# What generators write at the head of a file.
BANNER = re.compile(
    r"code generated by .{1,80}do not edit|@generated by|auto-?generated (?:file|by|from)|automatically generated|<auto-generated>|generated by .{1,60}do not (?:edit|modify)"
    r"|automatisch erzeugt durch|g[ée]n[ée]r[ée] automatiquement|generado autom[áa]ticamente",
    re.I,
)


def repair(seq: list, least: int = LEAST_USES) -> tuple[list[tuple[int, int]], np.ndarray, list[int], list[tuple[int, int] | None]]:
    """Re-Pair grammar of ``seq``: (expanded length, uses) of each rule, the top-level sequence, and of every symbol
    its expanded length and the pair behind it (None for a token).

    A pass replaces all most frequent pairs that share no symbol, down to half of the highest count, so the number of
    passes grows with the grammar's depth, not with its rules.
    """
    ids: dict = {}
    put_id = ids.setdefault
    a = np.array([put_id(x, len(ids)) for x in seq], np.int64)
    length, pairs = [1] * len(ids), [None] * len(ids)
    rules: list[tuple[int, int]] = []
    while len(a) > 1:
        size = len(length)
        key = a[:-1] * size + a[1:]
        order = key.argsort(kind="stable")
        line = key[order]
        edge = np.flatnonzero(line[1:] != line[:-1]) + 1
        first = np.concatenate([[0], edge])
        count = np.concatenate([edge, [len(line)]]) - first
        top = int(count.max())
        if top < least:
            break
        often = np.flatnonzero(count >= max(least, top / 2))
        often = often[np.argsort(-count[often], kind="stable")]
        busy: set[int] = set()
        gone = np.zeros(len(a), bool)
        b = a.copy()
        for k, pair, n in zip(often.tolist(), line[first[often]].tolist(), count[often].tolist()):
            x, y = divmod(pair, size)
            if x in busy or y in busy:
                continue
            busy.update((x, y))
            at = order[first[k] : first[k] + n]
            if x == y:  # only a symbol next to itself can overlap: every second place of such a run counts
                starts = np.concatenate([[True], at[1:] - at[:-1] != 1])
                at = at[(at - at[starts][np.cumsum(starts) - 1]) % 2 == 0]
            b[at] = len(length)
            gone[at + 1] = True
            length.append(length[x] + length[y])
            pairs.append((x, y))
            rules.append((length[-1], len(at)))
        a = b[~gone]
    return rules, a, length, pairs


def lex(text: str, py: bool, remarks: list[str] | None = None) -> tuple[list[str], list[str], list[str], int]:
    """(token classes, exact tokens, literals, characters in comments); ``remarks`` takes comments and leading docstrings."""
    said = [] if remarks is None else remarks
    classes, exact, literals, comments = [], [], [], 0
    for m in _TOKENS[py].finditer(text):
        kind, x = m.lastgroup, m.group()
        if kind == "punct":
            classes.append(x)
            if x not in ";,":
                exact.append(x)
        elif kind == "name":
            classes.append(x if x in KEYWORDS else "i")
            exact.append(x)
        elif kind == "number":
            classes.append("0")
            exact.append(x)
        elif kind == "comment":
            comments += len(x)
            said.append(x)
        else:
            if kind == "long" and not set(classes) - {"s"}:
                said.append(x)
            classes.append("s")
            exact.append(x.strip("\"'`"))
            literals.append(x)
    return classes, exact, literals, comments


@lru_cache(100_000)
def _crc(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


def phrases(exact: list[str]) -> np.ndarray:
    """Hashes of all windows of ``PHRASE`` exact tokens."""
    h = np.array(list(map(_crc, exact)), np.uint64)
    n = len(h) - PHRASE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(PHRASE):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Library:
    """Sorted phrases of some libraries with their owners, and the libraries' exact tokens."""

    phrase: np.ndarray
    owner: np.ndarray
    tokens: list[list[str]]

    @staticmethod
    def of(contents: list[tuple[str, bool]]) -> Library:
        tokens = [lex(text, py)[1] for text, py in contents]
        marks = [np.unique(phrases(x)) for x in tokens]
        phrase = np.concatenate([*marks, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(marks)), [len(x) for x in marks])
        order = np.argsort(phrase, kind="stable")
        return Library(phrase[order], owner[order], tokens)

    def nearest(self, exact: list[str]) -> tuple[int, float]:
        """(library, share of the tokens in windows that it has): the one with most; the first of equals."""
        marks = phrases(exact)
        left = np.searchsorted(self.phrase, marks)
        if not len(self.phrase) or not (self.phrase[np.minimum(left, len(self.phrase) - 1)] == marks).any():
            return -1, 0.0
        n = np.searchsorted(self.phrase, marks, "right") - left
        place = np.repeat(np.arange(len(marks)), n)
        who = self.owner[np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        best, most = -1, 0
        # a window covers at most PHRASE tokens, so a library with few of them can't be near
        for k in np.flatnonzero(np.bincount(who) * PHRASE >= CANDIDATE * len(exact)).tolist():
            edge = np.zeros(len(exact) + 1, np.int64)
            at = place[who == k]
            edge[at] += 1
            edge[at + PHRASE] -= 1
            covered = int((np.cumsum(edge) > 0).sum())
            if covered > most:
                best, most = k, covered
        return best, most / len(exact)


def shared_rules(library: list[str], exact: list[str]) -> float:
    """Share of a file's exact tokens that stand in rules of ``PHRASE`` tokens or more which the library uses, too.

    One grammar is inferred over the library, a separator and the file; of the file's top-level symbols those count
    that expand to a rule used on the library's side as well, or hold such rules.
    """
    _, top, length, pairs = repair([*library, None, *exact], 2)
    lone = next(k for k, x in enumerate(top.tolist()) if length[x] == 1 and x == _separator(library))
    ours: set[int] = set()
    todo = top[:lone].tolist()
    while todo:
        x = todo.pop()
        if x not in ours:
            ours.add(x)
            if pairs[x]:
                todo += pairs[x]
    covered, todo = 0, top[lone + 1 :].tolist()
    while todo:
        x = todo.pop()
        if length[x] >= PHRASE:
            if x in ours:
                covered += length[x]
            else:
                todo += pairs[x]
    return covered / max(1, len(exact))


def _separator(library: list[str]) -> int:
    """Number of the separator's symbol: tokens are numbered as they come."""
    return len(set(library))


def vendored(exact: list[str], library: Library) -> bool:
    """Whether a file is a copy of one of the libraries."""
    if len(exact) < 2 * PHRASE:
        return False
    k, near = library.nearest(exact)
    return near >= CANDIDATE and shared_rules(library.tokens[k], exact) >= COPY


def measure(text: str, py: bool, lexed: tuple) -> dict[str, float]:
    """What the decision rests on, libraries aside."""
    classes, exact, literals, comments, remarks = lexed
    n = len(classes)
    rules, top, _, _ = repair(classes)
    code = max(1, len(text) - comments)
    blob = "".join(x for x in literals if len(x) >= 20).encode("utf-8", "surrogatepass")
    names = [x for x in exact if (x[:1].isalpha() or x[:1] in "_$") and x not in KEYWORDS]
    space = sum(text.count(c) for c in " \n\t\r")
    return {
        "tokens": n,
        "reuse": max((a * b for a, b in rules), default=0) / max(1, n),
        "grammar": (len(top) + 2 * len(rules)) / max(1, n),
        "literals": sum(map(len, literals)) / code,
        "dense": len(zlib.compress(blob, 6)) / len(blob) if len(blob) >= 200 else 0.0,
        "numbers": classes.count("0") / max(1, n),
        "space": space / max(1, len(text)),
        "short": sum(len(x) <= 2 for x in names) / max(1, len(names)),
        "banner": float(any(map(BANNER.search, remarks))),
    }


#: Reasons in the order in which they count; the first of all blocks' is the file's.
REASONS = ("vendored", "data", "minified", "generated")


def reason(m: dict[str, float]) -> str:
    """Why a file that is no copy is not hand-written source of its repository, or ""."""
    if m["literals"] >= 0.8 and (m["dense"] >= 0.6 or m["reuse"] >= 0.85):
        return "data"
    if m["numbers"] >= 0.38 and m["tokens"] >= 40:
        return "data"
    if m["space"] <= 0.08 and m["short"] >= 0.4 and m["tokens"] >= 30:
        return "minified"
    if m["tokens"] >= 40 and m["reuse"] >= 0.6 and m["reuse"] - m["grammar"] >= 0.37:
        return "generated"
    if m["banner"] and m["reuse"] >= 0.4:
        return "generated"
    return ""


def verdict(text: str, ext: str, library: Library | None, alone: bool = True) -> str:
    """The first reason that holds, or ""; without ``alone`` only copies are looked for."""
    if text.lstrip("\ufeff \t\r\n")[:1] == "<":
        return ""
    lexed = (*lex(text, ext == "py", remarks := []), remarks)
    if not lexed[0]:
        return ""
    if library is not None and len(lexed[0]) >= 2 * PHRASE and vendored(lexed[1], library):
        return "vendored"
    return reason(measure(text, ext == "py", lexed)) if alone else ""


def _blocks(libraries: DataFrame) -> Iterator[Library]:
    """The libraries in blocks of bounded size, read through the driver one at a time; an empty one if there is none."""
    block: list[tuple[str, bool]] = []
    size = 0
    rows = libraries.select("lib_id", "lang", "content").where("content is not null").orderBy("lib_id")
    for r in rows.toLocalIterator():
        if block and size + len(r.content) > BLOCK_CHARS:
            yield Library.of(block)
            block, size = [], 0
        block.append((r.content, r.lang == "py"))
        size += len(r.content)
    yield Library.of(block)


def classified(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(file_id, reason): code files that are not hand-written, each with the first reason of ``REASONS`` that holds.

    The first block of libraries is searched together with all other measures, further ones for copies alone.
    """
    spark = files.sparkSession
    kind = files.schema["file_id"].dataType.simpleString()
    code = files.select("file_id", extension(F.col("url")).alias("ext"), "content").where(
        F.col("ext").isin(*CODE) & F.col("content").isNotNull()
    )
    parts, count = None, 0
    for block in _blocks(libraries):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared, alone=parts is None) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for i, ext, text in zip(b["file_id"], b["ext"], b["content"]):
                    why = verdict(text, ext, shared.value, alone)
                    if why:
                        rows.append((i, why))
                yield pd.DataFrame(rows, columns=["file_id", "reason"])

        part = code.mapInPandas(run, f"file_id {kind}, reason string")
        parts, count = part if parts is None else parts.unionByName(part), count + 1
    if count == 1:
        return parts
    rank = F.array_position(F.lit(list(REASONS)), F.col("reason")).cast("int")
    return parts.groupBy("file_id").agg(F.min(rank).alias("r")).select("file_id", F.element_at(F.lit(list(REASONS)), F.col("r")).alias("reason"))


def hand_written(files: DataFrame, analysis: DataFrame, libraries: DataFrame) -> DataFrame:
    """(file_id, repo, url, recovered): what remains when machine-made, vendored and data files are left out.

    ``recovered`` is true if the file or any analysis row of its URL says that it came out of a source map.
    """
    flags = analysis.where("recovered_from_source_map").select("url").distinct().withColumn("_r", F.lit(True))
    code = files.where(extension(F.col("url")).isin(*CODE) & F.col("content").isNotNull())
    kept = code.select("file_id", "repo", "url", "recovered_from_source_map").join(classified(files, libraries).select("file_id"), "file_id", "left_anti")
    return kept.join(flags, "url", "left").select(
        "file_id", "repo", "url", F.coalesce(F.col("recovered_from_source_map") | F.col("_r"), F.col("_r"), F.col("recovered_from_source_map"), F.lit(False)).alias("recovered")
    )
