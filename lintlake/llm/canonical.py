"""Visually identical text with different characters: one consistent form.

A longest-match transducer over grapheme clusters. Its mapping of code points is computed before any text is read, from
rules (compatibility forms, composition, kinds of space, invisible characters) and one fixed table of look-alike
letters, and is checked for conflicts: printable ASCII maps to itself, every output is a fixed point, and no two plain
letters of one alphabet meet. A cluster is a base character with the marks and invisible characters that follow it;
its output is its mapped base with its marks, composed. Texts without such followers take ``str.translate``.

Visible differences stay: letter case, accents, digits, punctuation, line breaks and the number of spaces.
Null stays null, an empty text stays empty; a text of invisible characters only becomes empty.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letter (or, for those without one, the Greek or phonetic letter)
# that they look like, as pairs.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y", "Ӏ": "I", "Ԁ": "D", "Ꮁ": "Г",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "г": "r", "к": "ĸ", "ԍ": "ɢ",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Γ": "Г", "Π": "П", "Φ": "Ф",
    "α": "a", "γ": "y", "ι": "i", "κ": "ĸ", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Օ": "O", "Ս": "U", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V",
    "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T",
    "Ⲩ": "Y", "Ⲭ": "X", "Ⲍ": "Z", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲓ": "i",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Cyrillic letters like Latin ones beyond ASCII, Cherokee small letters, Deseret
    "ӕ": "æ", "Ӕ": "Æ", "ә": "ə", "Ә": "Ə", "ꮓ": "z", "ꮩ": "v", "ꮃ": "w", "ꮪ": "s", "ꮯ": "c", "𐐄": "O", "𐐬": "o", "𐐠": "S",
    # Latin extensions drawn like a plain letter
    "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
# Letters of one alphabet that are drawn alike, so that both may have one output.
TWINS = [{"І", "Ӏ"}, {"У", "Ү"}, {"у", "ү"}, {"Ꮁ", "Г"}]

# Invisible characters outside category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
_INVISIBLE_RANGES = ((0xE0100, 0xE01F0),)


def _is_invisible(ch: str) -> bool:
    o = ord(ch)
    if ch in INVISIBLE or any(a <= o < b for a, b in _INVISIBLE_RANGES):
        return True
    kind = unicodedata.category(ch)
    return kind == "Cf" or kind == "Cc" and ch not in "\t\n\x0b\x0c\r\x85"


def _is_follower(ch: str) -> bool:
    """Marks, invisible characters and the vowels and finals of composed syllables belong to the cluster before."""
    return unicodedata.category(ch)[0] == "M" or _is_invisible(ch) or 0x1160 <= ord(ch) <= 0x11FF


def _apply(cluster: str) -> str:
    """The rules on one cluster; only used to fill the mapping."""
    out = []
    for ch in unicodedata.normalize("NFKD", "".join(x for x in cluster if not _is_invisible(x))):
        if unicodedata.category(ch) == "Zs":
            ch = " "
        if not _is_invisible(ch):
            out.append(LOOK_ALIKES.get(ch, ch))
    return unicodedata.normalize("NFC", "".join(out))


def _characters() -> Iterator[str]:
    """All code points of the planes that hold characters, without surrogates and private planes."""
    return map(chr, chain(range(0xD800), range(0xE000, 0x34000), range(0xE0000, 0xE1000)))


@lru_cache(50_000)
def _cluster(text: str) -> str:
    """Output of a cluster of several characters: the rules on all of it, kept for those that come again."""
    return _apply(text)


def mapping() -> dict[int, str]:
    """Every code point that does not stay itself, with its output; made from the rules before any text is read."""
    out: dict[int, str] = {}
    for ch in _characters():
        o = ord(ch)
        if unicodedata.decomposition(ch) or ch in LOOK_ALIKES or _is_invisible(ch) or unicodedata.category(ch) == "Zs":
            new = _apply(ch)
            if new != ch:
                out[o] = new
    check_conflicts(out)
    return out


def check_conflicts(table: dict[int, str]) -> None:
    """Raises ValueError if the mapping changes visible ASCII, maps an output again, or merges letters of one script.

    A code point has one output, as the table is a function; an output that is mapped again would make the form depend
    on how often it is applied. Two plain letters of one alphabet with one output would merge texts that look apart.
    """
    for o in [9, 10, 13, *range(32, 127)]:
        if o in table:
            raise ValueError(f"{chr(o)!r} would change")
    for o, new in table.items():
        if "".join(table.get(ord(x), x) for x in new) != new:
            raise ValueError(f"{chr(o)!r}: {new!r} is mapped again")
    seen: dict[tuple[str, str], str] = {}
    for ch, new in LOOK_ALIKES.items():
        if len(new) != 1:
            raise ValueError(f"{ch!r}: {new!r} is no letter")
        script = unicodedata.name(ch).split(" ")[0]
        if seen.setdefault((script, new), ch) != ch and {ch, seen[script, new]} not in TWINS:
            raise ValueError(f"{ch!r} and {seen[script, new]!r} are both {new!r}")


_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


@lru_cache(1)
def _compiled() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    followers = [ch for ch in _characters() if _is_follower(ch)]
    runs: list[list[int]] = []
    for ch in followers:
        if runs and runs[-1][1] == ord(ch) - 1:
            runs[-1][1] += 1
        else:
            runs.append([ord(ch), ord(ch)])
    cls = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return mapping(), re.compile(f"[{cls}]"), re.compile(f"[^{cls}]?[{cls}]+")


#: What the mapping or a cluster may change, with the character before it, which may be the base of a cluster.
_SPAN = re.compile(r"[\t-\r -~]?[^\t-\r -~]+")


def _transduce(text: str) -> str:
    """The transducer on any text."""
    table, follower, cluster = _compiled()
    if follower.search(text) is None:
        return text.translate(table)
    out, at = [], 0
    for m in cluster.finditer(text):
        out.append(text[at : m.start()].translate(table))
        out.append(_cluster(m.group()))
        at = m.end()
    out.append(text[at:].translate(table))
    return "".join(out)


_short = lru_cache(100_000)(_transduce)


def canonical(text: str) -> str:
    """The consistent form of ``text``. Plain ASCII maps to itself, so only the spans around other characters are read."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if text.isascii() and _CONTROL.search(text) is None:
        return text
    return _SPAN.sub(lambda m: (_short if m.end() - m.start() < 40 else _transduce)(m.group()), text)


def canonical_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, canonical): the consistent form of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "canonical": [None if t is None else canonical(t) for t in b[text_col]]})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, canonical string")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def look_alike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form, spelling): digests of the consistent form and of the text itself, for texts with a visible character."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b[id_col], b[text_col]):
                if t:
                    c = canonical(t)
                    if c and not c.isspace():
                        rows.append((i, _digest(c), _digest(t)))
            yield pd.DataFrame(rows, columns=[id_col, "form", "spelling"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, form binary, spelling binary")


#: A look-alike class above this share of all documents is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 200
#: Parts over which the documents of a hot class are spread when pairs are made.
SALTS = 32


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with form and spelling, spellings with their smallest id and copies, forms with their counts)."""
    from lintlake.sources.tables import cut

    rows = cut(look_alike_classes(docs, id_col, text_col))
    spellings = cut(rows.groupBy("form", "spelling").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n")))
    forms = spellings.groupBy("form").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("documents"))
    return rows, spellings, forms


def look_alike_membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, spelling_id, spellings, documents): one row per document with a visible character.

    ``class_id`` is the smallest id of all documents that look like it, ``spelling_id`` the smallest with the same
    string. Exact copies are aggregated before the shuffle; a hot class is looked up by broadcast (at most 200 rows).
    """
    rows, spellings, forms = _classes(docs, id_col, text_col)
    total = F.lit(rows.count() * HOT_SHARE)
    named = _named(spellings, forms)
    hot = named.where(F.col("n") > total)
    out = [id_col, "class_id", "spelling_id", "spellings", "documents"]
    near = rows.join(F.broadcast(hot), ["form", "spelling"]).select(*out)
    rest = rows.join(F.broadcast(hot.select("form", "spelling")), ["form", "spelling"], "left_anti").join(named.where(F.col("n") <= total), ["form", "spelling"])
    return near.unionByName(rest.select(*out))


def _named(spellings: DataFrame, forms: DataFrame) -> DataFrame:
    """Every spelling with its own and its class's smallest id."""
    return spellings.join(forms, "form").select("form", "spelling", "n", F.col("rep").alias("spelling_id"), "class_id", "spellings", "documents")


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b) of all documents that look the same while their strings differ, whatever the class's size.

    Exact copies are aggregated map-side before anything is compared, and classes of one spelling end there, hot ones
    without being moved. Pairs are made within a class only; the documents of a hot class are spread over salts.
    """
    rows, _, forms = _classes(docs, id_col, text_col)
    floor = F.lit(rows.count() * HOT_SHARE)
    hot = forms.where(F.col("documents") > floor).select("form", "spellings")
    rest = rows.join(F.broadcast(hot.select("form")), "form", "left_anti").join(forms.where((F.col("spellings") > 1) & (F.col("documents") <= floor)).select("form"), "form")
    warm = rows.join(F.broadcast(hot.where("spellings > 1").select("form")), "form")
    one, all_ = F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("form", "salt", F.col(id_col).alias(x), F.col("spelling").alias(f"s{x}"))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        return side(left, "a").join(side(right, "b"), ["form", "salt"]).where("a < b and sa <> sb").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))

    cold = rest.withColumn("salt", F.lit(0))
    return pairs(cold, cold).unionByName(pairs(warm.withColumn("salt", one), warm.withColumn("salt", all_)))
