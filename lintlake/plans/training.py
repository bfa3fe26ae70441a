"""Queries of the general training-data problems: snapshot changes and nested records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import nested, snapshot_diff
from lintlake.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.scan_diff(table(spark, d, "snapshot_endpoints"), table(spark, d, "snapshot_secrets"), table(spark, d, "scan_runs"))


def p1_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of items of each diff field per run."""
    return p1_found(spark, d).groupBy("scan_run_id", "diff_field").agg(F.count(F.lit(1)).alias("items"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_elements(table(spark, d, "scan_results").select("record_id", "payload"))


def p2_graphql_operations(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_table(
        table(spark, d, "scan_results").select("record_id", "payload"),
        ["graphql_operations[]"],
        {"op_type": "string", "op_name": "string", "endpoint": "string", "file": "string", "line": "int", "is_persisted": "boolean"},
    )


def p2_object_access_candidates(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_table(
        table(spark, d, "scan_results").select("record_id", "payload"),
        ["object_access_candidates[]"],
        {"endpoint": "string", "identifier": "string", "level": "int", "bug_class": "string", "function_name": "string"},
    )


def p2_dom_taint_findings(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_table(
        table(spark, d, "scan_results").select("record_id", "payload"),
        ["dom_taint_findings[]"],
        {"source.name": "string", "source.line": "int", "sink.name": "string", "sink.line": "int", "sink.category": "string"},
    )


#: Arrays below the roots: generic paths and (SQL type, column) of each member; "" is an element that is itself a scalar.
CHILDREN = {
    "p2_graphql_fields": (["graphql_operations[].fields[]*"], {"name": ("string", "name"), "alias": ("string", "alias")}),
    "p2_graphql_args": (["graphql_operations[].fields[]*.args[]"], {"name": ("string", "name"), "value": ("string", "value"), "value.gt": ("int", "value_gt")}),
    "p2_graphql_variables": (["graphql_operations[].variables[]"], {"": ("string", "value"), "name": ("string", "name"), "type": ("string", "type")}),
    "p2_graphql_directives": (["graphql_operations[].variables[].directives[]"], {"": ("string", "value")}),
    "p2_object_access_evidence": (["object_access_candidates[].evidence[]"], {"kind": ("string", "kind")}),
    "p2_object_access_lines": (["object_access_candidates[].evidence[].lines[]"], {"": ("int", "line")}),
    "p2_object_access_properties": (["object_access_candidates[].sensitive_properties[]"], {"": ("string", "value")}),
    "p2_dom_taint_steps": (["dom_taint_findings[].trace.steps[]"], {"line": ("int", "line")}),
    "p2_dom_taint_names": (["dom_taint_findings[].trace.steps[].names[]"], {"": ("string", "value")}),
    # members of the root rows that their tables lack, by the same row_key
    "p2_root_members": ([f"{x}[]" for x in nested.ROOTS], {"source_url": ("string", "source_url"), "trace.variable_bridge": ("string", "variable_bridge")}),
}


def _child(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.child_table(table(spark, d, "scan_results").select("record_id", "payload"), *CHILDREN[name])

    query.__name__ = name
    return query


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of every element of every array, also of arrays that have no table of their own."""
    return nested.scalar_members(table(spark, d, "scan_results").select("record_id", "payload"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_diff_counts, p2_found, p2_graphql_operations, p2_object_access_candidates, p2_dom_taint_findings,
        *map(_child, CHILDREN), p2_members,
    )
}

_P1 = """
with runs as (
  select scan_run_id, target, auth_only_js_urls, row_number() over (partition by target order by started_at, scan_run_id) as seq
  from (select scan_run_id, any_value(target) as target, min(started_at) as started_at, any_value(auth_only_js_urls) as auth_only_js_urls
        from scan_runs group by scan_run_id)),
pairs as (
  select b.scan_run_id as cur, a.scan_run_id as prev, coalesce(a.auth_only_js_urls, []) as prev_auth, coalesce(b.auth_only_js_urls, []) as cur_auth
  from runs a join runs b on a.target = b.target and b.seq = a.seq + 1),
e as (select distinct scan_run_id, value, pattern_name, source_url, tag, environment from snapshot_endpoints),
ev as (select distinct scan_run_id, value from e),
s as (select distinct scan_run_id, secret_type || ':' || partial_hash as item from snapshot_secrets),
found as (
  select p.cur as scan_run_id, 'new_endpoints' as diff_field, n.value as item from pairs p join ev n on n.scan_run_id = p.cur
  where not exists (select 1 from ev o where o.scan_run_id = p.prev and o.value = n.value)
  union all
  select p.cur, 'removed_endpoints', o.value from pairs p join ev o on o.scan_run_id = p.prev
  where not exists (select 1 from ev n where n.scan_run_id = p.cur and n.value = o.value)
  union all
  select distinct p.cur, 'changed_endpoints', n.value from pairs p join e n on n.scan_run_id = p.cur
  join e o on o.scan_run_id = p.prev and o.value = n.value and o.pattern_name is not distinct from n.pattern_name
    and o.source_url is not distinct from n.source_url
  where n.tag is distinct from o.tag or n.environment is distinct from o.environment
  union all
  select p.cur, 'new_secrets', n.item from pairs p join s n on n.scan_run_id = p.cur
  where not exists (select 1 from s o where o.scan_run_id = p.prev and o.item = n.item)
  union all
  select p.cur, 'removed_secrets', o.item from pairs p join s o on o.scan_run_id = p.prev
  where not exists (select 1 from s n where n.scan_run_id = p.cur and n.item = o.item)
  union all
  select distinct p.cur, 'access_control_regressions', n.value from pairs p
  join e o on o.scan_run_id = p.prev and list_contains(p.prev_auth, o.source_url)
  join e n on n.scan_run_id = p.cur and n.value = o.value and not list_contains(p.cur_auth, n.source_url))
"""

_P2 = """
with recursive docs as (select record_id, payload::json as j from scan_results where json_valid(payload)),
roots as (
  select record_id, name, case json_type(json_extract(j, '$.' || name)) when 'OBJECT' then json_array(json_extract(j, '$.' || name))
    when 'ARRAY' then json_extract(j, '$.' || name) end as node
  from docs, (values ('graphql_operations'), ('object_access_candidates'), ('dom_taint_findings')) r(name) where json_type(j) = 'OBJECT'),
walk as (
  select record_id, name as path, '' as parent_path, node, false as is_element from roots where node is not null
  union all
  select record_id, path, parent_path, node, is_element from (
    select w.record_id, w.path || '[' || i || ']' as path, case when w.is_element then w.path else w.parent_path end as parent_path,
      json_extract(w.node, '$[' || i || ']') as node, true as is_element
    from walk w, unnest(range(cast(json_array_length(w.node) as bigint))) t(i) where json_type(w.node) = 'ARRAY'
    union all
    select w.record_id, w.path || '.' || k, case when w.is_element then w.path else w.parent_path end,
      json_extract(w.node, '$."' || k || '"'), false
    from walk w, unnest(json_keys(w.node)) t(k) where json_type(w.node) = 'OBJECT'))
"""


def _p2_child(name: str, members: dict[str, tuple[str, str]]) -> str:
    cols = ", ".join(f"{how.format(at)} as {m}" for m, (at, how) in members.items())
    return _P2 + f"""
select record_id, sha256(record_id || '|' || path) as row_key, cast(null as varchar) as parent_key, path, parent_path,
  cast(regexp_extract(path, '\\[(\\d+)\\]$', 1) as int) as ordinal, {cols}
from walk where is_element and json_type(node) <> 'NULL' and regexp_matches(path, '^{name}\\[\\d+\\]$')"""


_S, _I, _B = "json_extract_string(node, '$.{}')", "cast(json_extract(node, '$.{}') as int)", "cast(json_extract(node, '$.{}') as boolean)"

ORACLES = {
    "p1_found": _P1 + "select * from found",
    "p1_diff_counts": _P1 + "select scan_run_id, diff_field, count(*) as items from found group by 1, 2",
    "p2_found": _P2 + "select record_id, path, parent_path from walk where is_element and json_type(node) <> 'NULL'",
    "p2_graphql_operations": _p2_child(
        "graphql_operations",
        {m: (m, _S) for m in ("op_type", "op_name", "endpoint", "file")} | {"line": ("line", _I), "is_persisted": ("is_persisted", _B)},
    ),
    "p2_object_access_candidates": _p2_child(
        "object_access_candidates",
        {"endpoint": ("endpoint", _S), "identifier": ("identifier", _S), "level": ("level", _I), "bug_class": ("bug_class", _S), "function_name": ("function_name", _S)},
    ),
    "p2_dom_taint_findings": _p2_child(
        "dom_taint_findings",
        {"source_name": ("source.name", _S), "source_line": ("source.line", _I), "sink_name": ("sink.name", _S), "sink_line": ("sink.line", _I), "sink_category": ("sink.category", _S)},
    ),
}


def _p2_below(lists: list[str], members: dict[str, tuple[str, str]]) -> str:
    """Rows of the arrays at generic paths, with the link to the row that held them."""
    paths = "|".join(re.sub(r"((?:^|\.)\w+)\[\](\*?)", lambda m: f"({m[1]}[[]\\d+[]])" + ("+" if m[2] else ""), x).replace(".", "[.]") for x in lists)
    cols = ", ".join(
        f"try_cast(case when {'json_type(node) not in (' + chr(39) + 'OBJECT' + chr(39) + ', ' + chr(39) + 'ARRAY' + chr(39) + ')' if not m else 'true'} then json_extract_string(node, '$" + ("." + m if m else "") + f"') end as {'int' if kind == 'int' else 'varchar'}) as {name}"
        for m, (kind, name) in members.items()
    )
    return _P2 + f"""
select record_id, sha256(record_id || '|' || path) as row_key, case when parent_path <> '' then sha256(record_id || '|' || parent_path) end as parent_key, path, parent_path,
  cast(regexp_extract(path, '\\[(\\d+)\\]$', 1) as int) as ordinal, {cols}
from walk where is_element and json_type(node) <> 'NULL' and regexp_matches(path, '^({paths})$')"""


ORACLES |= {name: _p2_below(*x) for name, x in CHILDREN.items()}
