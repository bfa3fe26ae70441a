"""Queries of the subpackage and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import canonical, format_dedup, generated, leakage, packing, secrets, syntax
from lintlake.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secrets(table(spark, d, "fetched_files")).select("file_id", "partial_hash").distinct()


def p3_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secrets(table(spark, d, "fetched_files"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(table(spark, d, "fetched_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dedup.duplicate_endpoints(table(spark, d, "endpoints"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return format_dedup.collapsed_endpoints(table(spark, d, "endpoints"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.classified(table(spark, d, "fetched_files"), table(spark, d, "library_files")).select("file_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return generated.classified(table(spark, d, "fetched_files"), table(spark, d, "library_files"))


def p5_hand_written(spark: SparkSession, d: str) -> DataFrame:
    return generated.hand_written(table(spark, d, "fetched_files"), table(spark, d, "file_analysis"), table(spark, d, "library_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "fetched_files")).select("file_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "fetched_files"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), table(spark, d, "container_sizes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Number of documents that hold each leaked item."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of texts that look like it and the smallest id with its very string."""
    return canonical.look_alike_membership(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_secrets, p3_redacted, p4_found, p4_collapsed, p5_found, p5_reasons, p5_hand_written, p6_found, p6_rates, p7_containers, p7_fill, p8_found, p8_items, p9_found, p9_classes, p9_canonical)}
_P4 = r"""
with shaped as (
  select endpoint_id, value, source_url,
    regexp_matches(value, '^[\s\p{P}\p{S}]*[A-Za-z_$][\w$]*["''`]?\s*:(?:[^/]|/[^/]|/?$)') as is_object
  from endpoints),
part as (
  select endpoint_id,
    case when is_object then '' else lower(regexp_replace(split_part(value, '?', 1), '[^\p{L}\p{N}\p{M}]', '', 'g')) end as fixed,
    list_sort(list_filter(list_transform(
      case when is_object then string_split(value, ',')
           when contains(value, '?') then string_split(substr(value, instr(value, '?') + 1), '&') else [] end,
      lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}\p{M}]', '', 'g'))), lambda x: x <> '')) as fields,
    is_object,
    lower(regexp_replace(split_part(source_url, '?', 1), '[^\p{L}\p{N}\p{M}]', '', 'g')) as source_fixed,
    list_sort(list_filter(list_transform(
      case when contains(source_url, '?') then string_split(substr(source_url, instr(source_url, '?') + 1), '&') else [] end,
      lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}\p{M}]', '', 'g'))), lambda x: x <> '')) as source_fields
  from shaped),
grouped as (
  select endpoint_id, min(endpoint_id) over g as first_endpoint_id, count(*) over g as copies
  from part window g as (partition by is_object, fixed, fields, source_fixed, source_fields))
"""

ORACLES: dict[str, str] = {
    "p4_found": _P4 + "select first_endpoint_id, endpoint_id from grouped where endpoint_id <> first_endpoint_id",
    "p4_collapsed": _P4 + "select first_endpoint_id, copies from grouped where endpoint_id = first_endpoint_id",
}
