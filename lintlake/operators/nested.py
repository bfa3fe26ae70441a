"""Nested JSON records as flat, related tables.

1. ``merged_schema`` finds every array of every record: generic paths such as ``fields[].args[]``. It is the union of
   structures, so mixed types at one place (an object here, a list there) lose nothing.
2. ``elements`` explodes level after level along the merged schema, as columns of one narrow stage over VARIANT
   values: each level is made from its parent's level and carries the parent's path and the ordinal. No shuffle.
3. ``child_table`` gives one table per array with its scalar members, ``row_key`` and ``parent_key``; ``scalar_members``
   has the scalars of every element of every array, known or not, as one long table.

Defined cases: a payload that is null or not valid JSON has no rows; text after the JSON value makes it invalid;
of members named twice the last counts; null elements keep their position but are no rows; a single object in place
of a root list is a list of one; a scalar in its place is nothing. A record sent twice counts twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lists of a scan result that become tables.
ROOTS = ("graphql_operations", "object_access_candidates", "dom_taint_findings")
#: A merged schema with more arrays than this (members used as keys of a map) is walked record by record instead.
MAX_ARRAYS = 1500
#: Payloads beyond this size do not fit a VARIANT and are walked instead.
MAX_VARIANT_CHARS = 8_000_000

Path = tuple[str, ...]  # member names; "" is the step into a list


def _arrays(x, at: Path, out: set[Path]) -> None:
    todo = [(x, at)]
    while todo:
        x, at = todo.pop()
        if isinstance(x, list):
            at = (*at, "")
            out.add(at)
            todo += [(y, at) for y in x if isinstance(y, list | dict)]
        elif isinstance(x, dict):
            todo += [(y, (*at, "." + k)) for k, y in x.items() if isinstance(y, list | dict)]


def _reject(name: str):
    raise ValueError(name)


def _load(text: str | None):
    """The JSON value of ``text`` or None; NaN and Infinity are not JSON."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None


def _roots(value, roots: Iterable[str]) -> Iterator[tuple[str, list]]:
    if isinstance(value, dict):
        for name in roots:
            x = value.get(name)
            if isinstance(x, list | dict):
                yield name, x if isinstance(x, list) else [x]


def merged_schema(df: DataFrame, payload: str, roots: tuple[str, ...] = ROOTS) -> list[Path] | None:
    """Sorted generic paths of all arrays under ``roots``, or None if there are more than ``MAX_ARRAYS``.

    Each task reduces its records to distinct paths, so what is shuffled and collected is the size of the schema.
    """

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[Path] = set()
        for b in batches:
            found: set[Path] = set()
            for text in b[payload]:
                for name, x in _roots(_load(text), roots):
                    _arrays(x, ("." + name,), found)
            new = found - seen
            seen |= new if len(seen) < 50 * MAX_ARRAYS else set()
            if new:
                yield pd.DataFrame({"path": [json.dumps(p) for p in new]})

    rows = df.select(payload).mapInPandas(infer, "path string").distinct().limit(MAX_ARRAYS + 1).collect()
    if len(rows) > MAX_ARRAYS:
        return None
    return sorted((tuple(json.loads(r.path)) for r in rows), key=lambda p: (len(p), p))


def _speakable(path: Path) -> bool:
    return not any(ch in step for step in path for ch in "\"'\\")


def _walk(df: DataFrame, id_col: str, payload: str, roots: tuple[str, ...]) -> DataFrame:
    """The same rows record by record, for what a VARIANT or a merged schema can't hold."""
    kind = df.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for rid, text in zip(b[id_col], b[payload]):
                todo = [(x, name, "") for name, x in _roots(_load(text), roots)]
                while todo:
                    x, at, parent = todo.pop()
                    if isinstance(x, list):
                        for i, y in enumerate(x):
                            if y is not None:
                                here = f"{at}[{i}]"
                                out.append((rid, here, parent))
                                if isinstance(y, list | dict):
                                    todo.append((y, here, here))
                    else:
                        todo += [(y, f"{at}.{k}", parent) for k, y in x.items() if isinstance(y, list | dict)]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=[id_col, "path", "parent_path"])
                    out = []
            yield pd.DataFrame(out, columns=[id_col, "path", "parent_path"])

    return df.select(id_col, payload).mapInPandas(walk, f"{id_col} {kind}, path string, parent_path string")


def strict_variant(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else, or null."""
    seal = F.md5(text)  # a member that no cut or padded payload can forge
    whole = F.try_parse_json(F.concat(F.lit('{"p":'), text, F.lit(',"'), seal, F.lit('":1}')))
    return F.when(F.to_json(F.struct(whole.alias("x"))).contains(seal), F.try_variant_get(whole, "$.p", "variant"))


_LEVEL = "array<struct<path:string,parent_path:string,ordinal:int,elem:variant>>"


def _root_level(at: str, label: str) -> Column:
    """Elements of a root list; an object in its place is its only element."""
    got = F.try_variant_get("_v", at, "variant")
    kind = F.schema_of_variant(got)
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("_v", at, "array<variant>")).when(kind.startswith("OBJECT"), F.array(got))

    def row(x: Column, i: Column) -> Column:
        path = F.concat(F.lit(label + "["), i.cast("string"), F.lit("]"))
        return F.struct(path.alias("path"), F.lit("").alias("parent_path"), i.cast("int").alias("ordinal"), x.alias("elem"))

    return F.transform(items, row)


def _child_level(parent: str, at: str, label: str) -> Column:
    """Elements of the lists at ``at`` in every element of the parent's level."""

    def of_parent(e: Column) -> Column:
        is_list = F.schema_of_variant(F.try_variant_get(e["elem"], at, "variant")).startswith("ARRAY")

        def row(x: Column, i: Column) -> Column:
            path = F.concat(e["path"], F.lit(label + "["), i.cast("string"), F.lit("]"))
            return F.struct(path.alias("path"), e["path"].alias("parent_path"), i.cast("int").alias("ordinal"), x.alias("elem"))

        items = F.when(is_list, F.try_variant_get(e["elem"], at, "array<variant>"))
        return F.coalesce(F.transform(items, row), F.array().cast(_LEVEL))

    return F.flatten(F.transform(F.col(parent), of_parent))


def elements(df: DataFrame, schema: list[Path], id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """(id, path, parent_path, ordinal, list_path, elem): one row per non-null element of the arrays of ``schema``."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    work = df.select(id_col, strict_variant(F.col(payload)).alias("_v"))
    names: dict[Path, str] = {}
    for k, path in enumerate(schema):
        names[path] = f"_l{k}"
        parent = next((path[:n] for n in range(len(path) - 1, 0, -1) if path[:n] in names), None)
        steps = path[len(parent or ()) : -1]  # members from the parent's element to this list
        at, label = "$" + "".join(f'["{s[1:]}"]' for s in steps), "".join(steps)
        level = _child_level(names[parent], at, label) if parent else _root_level(at, label[1:])
        kept = F.filter(level, lambda e: F.schema_of_variant(e["elem"]) != "VOID")
        work = work.withColumn(names[path], F.coalesce(kept, F.array().cast(_LEVEL)))
    lists = F.array(*[F.struct(F.lit(list_path(p)).alias("list_path"), F.col(c).alias("rows")) for p, c in names.items()])
    flat = work.select(id_col, F.explode(lists).alias("_t")).select(id_col, "_t.list_path", F.explode("_t.rows").alias("_r"))
    return flat.select(id_col, "_r.path", "_r.parent_path", "_r.ordinal", "list_path", "_r.elem")


def list_path(path: Path) -> str:
    return "".join("[]" if s == "" else s for s in path)[1:]


def nested_elements(df: DataFrame, id_col: str = "record_id", payload: str = "payload", roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """(record_id, path, parent_path) of every non-null element under the root lists."""
    schema = merged_schema(df, payload, roots)
    if not schema or not all(map(_speakable, schema)):
        return _walk(df, id_col, payload, roots)
    big = F.coalesce(F.length(payload) > MAX_VARIANT_CHARS, F.lit(False))
    rows = elements(df.where(~big), schema, id_col, payload).select(id_col, "path", "parent_path")
    return rows.unionByName(_walk(df.where(big), id_col, payload, roots))


class _Number(str):
    """A number in the spelling of its payload."""


def _load_exact(text: str | None):
    """As ``_load``, but numbers keep their spelling."""
    return None if _load(text) is None else json.loads(text, parse_float=_Number, parse_int=_Number)


def _json(x) -> str:
    """JSON text of a value of ``_load_exact``."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_json(y)}" for k, y in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_json, x)) + "]"
    return str(x) if isinstance(x, _Number) else json.dumps(x)


def _elements(value, roots: tuple[str, ...]) -> Iterator[tuple[str, str, int, str, object]]:
    """(path, parent_path, ordinal, list_path, element) of every non-null element of a record."""
    todo = [(x, name, "", name) for name, x in _roots(value, roots)]
    while todo:
        x, at, parent, general = todo.pop()
        if isinstance(x, list):
            for i, y in enumerate(x):
                if y is not None:
                    here = f"{at}[{i}]"
                    yield here, parent, i, general + "[]", y
                    if isinstance(y, list | dict):
                        todo.append((y, here, here, general + "[]"))
        else:
            todo += [(y, f"{at}.{k}", parent, f"{general}.{k}") for k, y in x.items() if isinstance(y, list | dict)]


def _scalars(x, at: str = "") -> Iterator[tuple[str, object]]:
    """Scalars of an element outside its arrays, by member path; the element itself has the path ""."""
    todo = [(x, at)]
    while todo:
        x, at = todo.pop()
        if isinstance(x, dict):
            todo += [(y, f"{at}.{k}" if at else k) for k, y in x.items()]
        elif not isinstance(x, list):
            yield at, x


def _list_pattern(lists: list[str]) -> re.Pattern:
    """``fields[]*`` in a generic path stands for that step once or more."""
    steps = (re.sub(r"(\\\.\w+\\\[\\\])\\\*", r"(?:\1)+", re.escape(x)) for x in lists)
    return re.compile("|".join(steps))


def _walk_members(df: DataFrame, lists: re.Pattern, members: list[str], id_col: str, payload: str, roots: tuple[str, ...]) -> DataFrame:
    """The rows of ``elements`` record by record; an element keeps only the first steps of the members asked for."""
    kind = df.schema[id_col].dataType.simpleString()
    columns = [id_col, "path", "parent_path", "ordinal", "elem"]
    first = {m.split(".")[0] for m in members}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for rid, text in zip(b[id_col], b[payload]):
                for path, parent, i, general, x in _elements(_load_exact(text), roots):
                    if lists.fullmatch(general):
                        kept = {k: y for k, y in x.items() if k in first} if isinstance(x, dict) else [] if isinstance(x, list) else x
                        out.append((rid, path, parent, i, _json(kept)))
                        if len(out) > 50_000:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
            yield pd.DataFrame(out, columns=columns)

    rows = df.select(id_col, payload).mapInPandas(walk, f"{id_col} {kind}, path string, parent_path string, ordinal int, elem string")
    return rows.withColumn("elem", F.try_parse_json("elem"))


def _key(id_col: str, path: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.col(path)), 256)


def _keys(id_col: str) -> list[Column]:
    return [_key(id_col, "path").alias("row_key"), F.when(F.col("parent_path") != "", _key(id_col, "parent_path")).alias("parent_key")]


def _member(path: str, kind: str) -> Column:
    if path:
        return F.try_variant_get("elem", "$" + "".join(f'["{x}"]' for x in path.split(".")), kind)
    itself = F.schema_of_variant("elem")
    return F.when(~(itself.startswith("OBJECT") | itself.startswith("ARRAY")), F.try_variant_get("elem", "$", kind))


def child_table(df: DataFrame, lists: list[str], members: dict[str, str], id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """Flat table of the arrays whose generic path is in ``lists``: keys, ordinal and the named members.

    ``fields[]*`` in a generic path is that step once or more. ``members`` maps a member path such as ``sink.line`` to
    its SQL type, or to (type, column name); "" is an element that is itself a scalar. A member of another type is null.
    ``parent_key`` is the ``row_key`` of the row that held the element, null for rows of a root list.
    Payloads and schemas that a VARIANT or a merged schema can't hold are walked record by record to the same rows.
    """
    roots = tuple(dict.fromkeys(x.split("[")[0].split(".")[0] for x in lists))
    pattern = _list_pattern(lists)
    schema = merged_schema(df, payload, roots)
    wanted = [p for p in schema or [] if pattern.fullmatch(list_path(p))]
    need = [p for p in schema or [] if any(w[: len(p)] == p for w in wanted)]
    if not need or not all(map(_speakable, need)):
        rows = _walk_members(df, pattern, list(members), id_col, payload, roots)
    else:
        big = F.coalesce(F.length(payload) > MAX_VARIANT_CHARS, F.lit(False))
        rows = elements(df.where(~big), need, id_col, payload).where(F.col("list_path").isin([list_path(p) for p in wanted])).drop("list_path")
        rows = rows.unionByName(_walk_members(df.where(big), pattern, list(members), id_col, payload, roots))
    named = {m: kind if isinstance(kind, tuple) else (kind, m.replace(".", "_")) for m, kind in members.items()}
    return rows.select(id_col, *_keys(id_col), "path", "parent_path", "ordinal", *[_member(m, kind).alias(name) for m, (kind, name) in named.items()])


def scalar_members(df: DataFrame, id_col: str = "record_id", payload: str = "payload", roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """One row per scalar of every element of every array under ``roots``, whatever the schema.

    ``member`` is the path from the element ("" for an element that is itself a scalar), ``kind`` its JSON type and
    ``value`` its text, null for JSON's null. One narrow scan without a merged schema.
    """
    kind = df.schema[id_col].dataType.simpleString()
    columns = [id_col, "path", "parent_path", "ordinal", "list_path", "member", "kind", "value"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for rid, text in zip(b[id_col], b[payload]):
                for path, parent, i, general, x in _elements(_load_exact(text), roots):
                    for member, y in _scalars(x):
                        what = "null" if y is None else "boolean" if isinstance(y, bool) else "number" if isinstance(y, _Number) else "string"
                        out.append((rid, path, parent, i, general, member, what, None if y is None else str(y).lower() if isinstance(y, bool) else str(y)))
                    if len(out) > 50_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    rows = df.select(id_col, payload).mapInPandas(walk, f"{id_col} {kind}, path string, parent_path string, ordinal int, list_path string, member string, kind string, value string")
    return rows.select(id_col, *_keys(id_col), "path", "parent_path", "ordinal", "list_path", "member", "kind", "value")
