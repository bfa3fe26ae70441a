"""SQL for the comparison engine: matches of patterns with lines, first-wins and small helpers."""

from __future__ import annotations

from lintlake.functions.text import Pattern


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(p: Pattern) -> str:
    """The pattern without look-around; flags in front."""
    return lit((f"(?{p.flags})" if p.flags else "") + (p.sql or p.regex))


def has(p: Pattern, column: str = "content") -> str:
    return f"coalesce(regexp_matches({column}, {rx(p)}), false)"


def values(p: Pattern, column: str = "content") -> str:
    return f"regexp_extract_all({column}, {rx(p)}, {p.group})"


def lower_trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def hits(source: str, patterns: list[Pattern], keep: str = "file_id, url") -> str:
    """(keep, pat_ord, name, match_ord, line, text, value) over a relation with ``content``."""
    parts = []
    for k, p in enumerate(patterns):
        parts.append(
            f"select {keep}, {k} as pat_ord, {lit(p.name)} as name, i as match_ord, "
            f"1 + length(regexp_replace(array_to_string(gaps[1:i], '') || array_to_string(m[1:i-1], ''), '[^\\n]', '', 'g')) as line, m[i] as text, v[i] as value "
            f"from (select *, unnest(range(1, len(m) + 1)) as i from (select *, regexp_extract_all(content, {rx(p)}, 0) as m, regexp_extract_all(content, {rx(p)}, {p.group}) as v, "
            f"string_split_regex(content, {rx(p)}) as gaps from {source} where regexp_matches(content, {rx(p)})))"
        )
    return "(" + " union all ".join(parts) + ")"


def first_wins(rows: str, keys: str, order: str = "pat_ord, match_ord") -> str:
    return f"(select * exclude (_r) from (select *, row_number() over (partition by {keys} order by {order}) as _r from {rows}) where _r = 1)"


def names_where(patterns: list[Pattern], column: str = "content") -> str:
    """Names of the patterns that occur, in order."""
    return "list_filter([" + ", ".join(f"case when {has(p, column)} then {lit(p.name)} end" for p in patterns) + "], lambda x: x is not null)"


def case_map(column: str, table: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items()) + " end"


HOST = "lower(regexp_replace(regexp_replace(regexp_extract(case when contains({0}, '://') then {0} else 'https://' || {0} end, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\\d*$', ''))"
PATH = "case when contains({0}, '://') and regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) <> '' then regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) else '/' end"
