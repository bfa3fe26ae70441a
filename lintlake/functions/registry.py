"""Extension points: patterns added by name, and the kernels as SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import patterns as P
from lintlake.functions.text import Pattern, hits

FAMILIES: dict[str, list[Pattern]] = {
    "endpoints": list(P.ENDPOINTS), "frameworks": list(P.FRAMEWORKS), "dom_sinks": list(P.DOM_SINKS), "dom_sources": list(P.DOM_SOURCES), "feature_flags": list(P.FLAGS),
}


def register_pattern(family: str, name: str, regex: str, group: int = 0, flags: str = "") -> None:
    """Adds a pattern to a family, a new one if need be; a name that exists is replaced in its place."""
    known = FAMILIES.setdefault(family, [])
    p = Pattern(name, regex, group, flags)
    at = next((i for i, q in enumerate(known) if q.name == name), None)
    if at is None:
        known.append(p)
    else:
        known[at] = p


def find_all(docs: DataFrame, family: str) -> DataFrame:
    """(file_id, url, name, line, value) of a family's patterns, literals compiled into the plan."""
    rows = docs.where(F.col("content").isNotNull()).select("file_id", "url", F.explode(hits("content", FAMILIES[family])).alias("h"))
    return rows.select("file_id", "url", "h.name", "h.line", "h.value")


#: Kernels as SQL functions; bodies are SQL, so they are inlined and stay inside the JVM.
SQL_FUNCTIONS = {
    "identifier_words(name STRING) RETURNS ARRAY<STRING>": r"filter(transform(split(name, '[_\\-$]|(?<=[a-z0-9])(?=[A-Z])'), x -> lower(x)), x -> x <> '')",
    "stable_id3(a STRING, b STRING, c STRING) RETURNS STRING": "substr(sha2(concat_ws(':', coalesce(a, ''), coalesce(b, ''), coalesce(c, '')), 256), 1, 16)",
    "path_template(value STRING) RETURNS STRING": r"regexp_replace(regexp_replace(value, '/:[a-zA-Z_][a-zA-Z0-9_]*|\\{[a-zA-Z_][a-zA-Z0-9_]*\\}', '/REPLACE_ID'), '(/)\\d{3,}', '$1REPLACE_ID')",
}


def register_sql(spark: SparkSession) -> list[str]:
    """Creates the SQL functions for this session and returns their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in SQL_FUNCTIONS]
