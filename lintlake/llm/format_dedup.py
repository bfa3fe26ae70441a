"""Records that differ only in white space, letter case, punctuation or the order of fields.

Merkle-style hashing of a record (value, source_url) from the bottom up: a leaf is normalised to lower-case letters,
digits and marks and hashed; a node's digest is that of its kind, its ordered part and the sorted digests of its
unordered children (query parameters, object members, at any depth); the root digest is made from both fields'. Rows
are grouped by the root digest, 8 bytes each, and only rows of groups of two or more are confirmed by comparing their
whole canonical structure. Structures that share a digest by chance are groups of their own.

The table is read twice (flat and nested values) and written once to the shared folder as (id, root, canon). A group
that holds more than 1/200 of all rows is hot: there are at most 200 of them by the pigeonhole principle, so their
digests (8 bytes each) are broadcast, their rows stay where they are, and their structures are aggregated map-side and
joined back over salts. All other groups go through one shuffle of the rows that have copies.

Defined cases: a null value or source_url equals another null only; an empty text, or one of punctuation only, equals
another such text; repeated rows with one id are one record.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.sources.tables import cut

#: A group above this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 200
#: Parts over which the rows of a hot group are spread when they meet its structure.
SALTS = 64
#: What a leaf leaves out, for both engines.
NOISE = r"[^\p{L}\p{N}\p{M}]++"
#: An object literal starts with a bare or quoted member name and a colon that starts no URL.
OBJECT_LITERAL = r"^[\s\p{P}\p{S}]*+[A-Za-z_$][\w$]*+[\"'`]?\s*+:(?!//)"
#: Members end at a comma outside quotes; possessive, so that long texts use no stack.
MEMBER = r"(?:[^,'\"`]++|'[^']*+'|\"[^\"]*+\"|`[^`]*+`|['\"`])++"
QUOTED = r"'[^']*+'|\"[^\"]*+\"|`[^`]*+`"
_NOISE = regex.compile(NOISE)
_PART = regex.compile(r"'[^']*+'|\"[^\"]*+\"|`[^`]*+`|[{}\[\],]|[^{}\[\],'\"`]++|['\"`]")


def normal_leaf(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, NOISE, ""))


def _children(parts: Column) -> Column:
    """Normalised, non-empty leaves in a fixed order."""
    return F.array_sort(F.filter(F.transform(parts, normal_leaf), lambda x: x != ""))


def _canon(kind: str, fixed: Column, children: Column) -> Column:
    return F.concat(F.lit(kind), fixed, F.lit("\u0001"), F.array_join(children, "\u0002"))


def _digest(kind: str, fixed: Column, children: Column) -> Column:
    """Digest of a node from its kind, its ordered part and the sorted digests of its children."""
    return F.xxhash64(F.lit(kind), fixed, F.array_sort(F.transform(children, lambda x: F.xxhash64(x))))


def _hash(*parts: str | int) -> int:
    body = "\u0000".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def shape(s: str) -> tuple[str, int]:
    """(canonical structure, digest) of an object literal that holds further objects or lists."""

    def end(parts: list[str | tuple[str, int]]) -> tuple[str, int]:
        """A finished child: runs of leaf text and the groups between them."""
        texts = [p if isinstance(p, str) else p[0] for p in parts]
        return "".join(texts), _hash("leaf", *(p if isinstance(p, str) else p[1] for p in parts))

    def close(kind: str, children: list[tuple[str, int]], last: list) -> tuple[str, int]:
        done = [x for x in [*children, end(last)] if x[0]]
        if kind == "{":
            done.sort()
        digests = [d for _, d in done]
        return kind + "\u0003".join(t for t, _ in done) + {"{": "}", "[": "]"}[kind], _hash(kind, *(sorted(digests) if kind == "{" else digests))

    # each frame: kind, finished children, parts of the child being read
    stack: list[list] = [["{", [], []]]
    for m in _PART.finditer(s):
        t = m.group()
        if t in ("{", "["):
            stack.append([t, [], []])
        elif t in ("}", "]"):
            if len(stack) > 1:
                got = close(*stack.pop())
                stack[-1][2].append(got)
        elif t == ",":
            stack[-1][1].append(end(stack[-1][2]))
            stack[-1][2] = []
        elif leaf := _NOISE.sub("", t).lower():
            parts = stack[-1][2]
            if parts and isinstance(parts[-1], str):
                parts[-1] += leaf
            else:
                parts.append(leaf)
    while len(stack) > 1:
        got = close(*stack.pop())
        stack[-1][2].append(got)
    return close(*stack[0])


@F.pandas_udf(T.StructType([T.StructField("canon", T.StringType()), T.StructField("digest", T.LongType())]))
def nested_structure(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if v is None else ("n" + shape(v)[0], shape(v)[1]) for v in values], columns=["canon", "digest"])


def structures(df: DataFrame, value: str = "value", source: str = "source_url") -> DataFrame:
    """``df`` with ``canon``, the canonical structure of both fields, and ``root``, its digest."""
    v = F.col(value)
    brackets = F.length(v) - F.length(F.translate(v, "{[", ""))
    is_object = v.rlike(OBJECT_LITERAL)
    deep = F.coalesce((brackets > 1) & is_object & (F.regexp_count(F.regexp_replace(v, QUOTED, ""), F.lit(r"[{\[]")) > 1), F.lit(False))
    none = F.array().cast("array<string>")

    def query(c: Column) -> Column:
        return F.coalesce(F.when(F.instr(c, "?") > 0, F.split(F.substr(c, F.instr(c, "?") + 1), "&")), none)

    s = F.col(source)
    rows = df.withColumns({"_sf": normal_leaf(F.substring_index(s, "?", 1)), "_sc": _children(query(s))})
    rows = rows.withColumns({
        "_source": F.coalesce(_canon("u", F.col("_sf"), F.col("_sc")), F.lit("-")), "_source_digest": F.when(s.isNotNull(), _digest("u", F.col("_sf"), F.col("_sc"))).otherwise(F.lit(0)),
    }).drop("_sf", "_sc")
    flat = rows.where(~deep).withColumns({
        "_kind": F.when(is_object, "o").otherwise("u"), "_fixed": F.when(is_object, "").otherwise(normal_leaf(F.substring_index(v, "?", 1))),
        "_kids": _children(F.when(is_object, F.regexp_extract_all(v, F.lit(MEMBER), F.lit(0))).otherwise(query(v))),
    })
    digest = F.xxhash64("_kind", "_fixed", F.array_sort(F.transform("_kids", lambda x: F.xxhash64(x))))
    canon = F.concat("_kind", "_fixed", F.lit("\u0001"), F.array_join("_kids", "\u0002"))
    flat = flat.withColumns({"_value": F.when(v.isNull(), "-").otherwise(canon), "_digest": F.when(v.isNull(), F.lit(0)).otherwise(digest)}).drop("_kind", "_fixed", "_kids")
    nested = rows.where(deep).withColumn("_n", nested_structure(v)).withColumns({"_value": F.col("_n.canon"), "_digest": F.col("_n.digest")}).drop("_n")
    both = flat.unionByName(nested)
    return both.withColumns({"canon": F.concat("_value", F.lit("\u0004"), "_source"), "root": F.xxhash64("_digest", "_source_digest")}).drop("_value", "_digest", "_source", "_source_digest")


def members(df: DataFrame, id_col: str = "endpoint_id", value: str = "value", source: str = "source_url") -> DataFrame:
    """(first_id, id) of each record that is not the smallest id of its group."""
    keyed = cut(structures(df.select(F.col(id_col).alias("id"), value, source), value, source).select("id", "canon", "root"))
    by_root = cut(keyed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    floor = F.lit(keyed.count() * HOT_SHARE)
    hot = F.broadcast(by_root.where(F.col("n") > floor).select("root"))

    # most groups: one shuffle by digest of the rows with copies, confirmed by the whole structure
    group = Window.partitionBy("root", "canon")
    rest = keyed.join(by_root.where(F.col("n") <= floor).select("root"), "root", "left_semi").select("id", F.min("id").over(group).alias("first_id"))
    # hot groups: structures aggregated where the rows lie, then met by the rows over salts
    warm = keyed.join(hot, "root", "left_semi")
    first = warm.groupBy("root", "canon").agg(F.min("id").alias("first_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = warm.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(first, ["root", "canon", "salt"]).select("id", "first_id")
    return rest.unionByName(spread).where("id <> first_id").select("first_id", "id")


def duplicate_endpoints(endpoints: DataFrame) -> DataFrame:
    """(first_endpoint_id, endpoint_id) for each copy that is not the smallest id of its group."""
    return members(endpoints).select(F.col("first_id").alias("first_endpoint_id"), F.col("id").alias("endpoint_id"))


def collapsed_endpoints(endpoints: DataFrame) -> DataFrame:
    """(first_endpoint_id, copies): one record per group; rows without a copy count 1."""
    keyed = structures(endpoints.select("endpoint_id", "value", "source_url"))
    groups = keyed.groupBy("root", "canon").agg(F.min("endpoint_id").alias("first_endpoint_id"), F.count(F.lit(1)).alias("copies"))
    return groups.select("first_endpoint_id", "copies")
