"""Column kernels that every extractor is made of; all run inside the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIT = "array<struct<pat_ord:int,name:string,match_ord:int,line:int,text:string,value:string>>"


@dataclass(frozen=True)
class Pattern:
    """A named pattern; ``group`` is the value, ``flags`` some of i, s, m. ``sql`` is the same for an engine without
    look-around, where it differs."""

    name: str
    regex: str
    group: int = 0
    flags: str = ""
    sql: str = ""

    @property
    def java(self) -> str:
        """Line rules and word classes of the specification: only a line feed ends a line, words are Unicode."""
        return f"(?dU{self.flags}){self.regex}"


def has(content: Column | str, p: Pattern) -> Column:
    """Whether the pattern occurs; null contents hold nothing."""
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(c.rlike(p.java), F.lit(False))


def first(content: Column | str, p: Pattern) -> Column:
    """The first match's value, or null."""
    return F.nullif(F.regexp_extract(content, p.java, p.group), F.lit(""))


def all_values(content: Column | str, p: Pattern) -> Column:
    return F.regexp_extract_all(content, F.lit(p.java), F.lit(p.group))


def hits(content: Column | str, patterns: list[Pattern]) -> Column:
    """All matches of all patterns with pattern order, match order, line (from 1), text and value.

    The text between matches is cut out once by ``split``; line numbers are a running sum over pieces and matches, so
    a long text is scanned twice for a pattern and never again for a match.
    """
    c = F.col(content) if isinstance(content, str) else content
    out = []
    for k, p in enumerate(patterns):
        text = F.regexp_extract_all(c, F.lit(p.java), F.lit(0))
        value = F.regexp_extract_all(c, F.lit(p.java), F.lit(p.group)) if p.group else text
        gaps = F.split(c, p.java, -1)
        steps = F.zip_with(F.slice(gaps, 1, F.size(text)), text, lambda g, t: F.struct(_breaks(g).alias("g"), _breaks(t).alias("t")))
        # lines before each match: own piece and all that came before
        lines = F.aggregate(
            steps,
            F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, s: F.struct((acc["at"] + s["g"] + s["t"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + s["g"])).alias("out")),
        )["out"]
        rows = F.transform(F.arrays_zip(text.alias("text"), value.alias("value"), lines.alias("line")), _row(k, p.name))
        found = F.when(c.rlike(p.java), rows)
        out.append(F.coalesce(found, F.array().cast(_HIT)))
    return F.concat(*out) if len(out) > 1 else out[0]


def _breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _row(order: int, name: str):
    def row(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(order).alias("pat_ord"), F.lit(name).alias("name"), (i + 1).cast("int").alias("match_ord"), x["line"].alias("line"),
            x["text"].alias("text"), x["value"].alias("value"),
        )

    return row


def words(name: Column) -> Column:
    """Lower-case words of an identifier, split at _ - $ and before capitals that follow a small letter or digit."""
    return F.filter(F.transform(F.split(name, r"[_\-$]|(?<=[a-z0-9])(?=[A-Z])"), F.lower), lambda w: w != "")


def context(content: Column, line: Column, reach: int) -> Column:
    """Lines ``line`` - reach to ``line`` + reach of the text."""
    lines = F.split(content, "\n", -1)
    start = F.greatest(F.lit(1), line - reach)
    return F.array_join(F.slice(lines, start, line + reach - start + 1), "\n")


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by a colon; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def entropy(token: Column) -> Column:
    """Shannon entropy in bits per character; characters in sorted order, so sums repeat to the bit."""
    n = F.length(token)
    shares = F.transform(F.array_sort(F.array_distinct(F.split(token, ""))), lambda ch: (n - F.length(F.replace(token, ch, F.lit("")))) / n)
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


# URLs -----------------------------------------------------------------------------------------------------------


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def hostname(u: Column) -> Column:
    """Lower-case host of a URL or of a bare host; without user, port and path."""
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.lower(F.regexp_replace(F.regexp_replace(authority(full), r"^.*@", ""), r":\d*$", ""))


def path(u: Column) -> Column:
    p = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(u.contains("://") & (p != ""), p).otherwise("/")


def path_and_query(u: Column) -> Column:
    p = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    q = F.regexp_extract(u, r"^[^?#]*\?([^#]+)", 1)
    return F.concat(p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (authority(a) == authority(b))


def resolve(base: Column, ref: Column) -> Column:
    """``ref`` against ``base``: absolute, ``//host``, ``/path``, ``?query``, ``#part`` or relative; dot segments go."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    here = F.regexp_extract(base, r"^([^?#]*)", 1)
    joined = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref == "", base)
        .when(ref.startswith("?"), F.concat(here, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), ref))
    )
    dotted = joined.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*/\.{1,2}(?:/|$|[?#])")
    return F.when(dotted, _undot(joined)).otherwise(joined)


def _undot(u: Column) -> Column:
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(u, r"^[^?#]*(.*)$", 1)
    parts = F.split(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/", -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.concat(head, F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), F.lit("/")).otherwise(""), tail)
