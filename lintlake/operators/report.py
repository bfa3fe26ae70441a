"""Operators that reports and later stages are made of: normal forms, routing, lookups, shapes of endpoints, messages.

Null keys equal null keys. What is looked up is reduced to one row per key first, so a key that holds a third of all
rows is one row before it meets the other side; ties are decided by an order column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.operators.process import normalized

# The columns that make a row of each family one and the same finding.
NORMAL_KEYS = {
    "endpoints": ["pattern_name", "value", "source_url"],
    "secrets": ["secret_type", "partial_hash", "source_url"],
    "files": ["url"],
    "subdomains": ["domain", "source_url"],
    "parameters": ["name", "source_url"],
    "dom_findings": ["sink_pattern", "source_url"],
    "cors": ["source_url"],
    "third_party_scripts": ["hostname", "script_url"],
    "ai_verdicts": ["evidence_id"],
    "entropy_tokens": ["partial_hash", "source_url"],
    "comments": ["source_url", "line", "keyword_matched"],
    "feature_flags": ["key", "source_url", "line"],
    "dependencies": ["name", "version", "file"],
    "symbols": ["name", "file", "line"],
    "api_groups": ["group_name"],
    "graphql_ops": ["op_type", "op_name", "source_url"],
    "websockets": ["endpoint", "source_url"],
    "auth_findings": ["finding_type", "line", "source_url"],
    "object_access": ["endpoint", "bug_class", "source_url"],
    "dom_taint": ["source_name", "source_line", "sink_name", "sink_line", "source_url"],
    "proto_pollution": ["pattern_name", "line", "source_url"],
    "postmessage": ["kind", "line", "source_url"],
    "workers": ["worker_type", "worker_url", "source_url"],
    "asset_graph": ["chunk_url"],
}
# Words that tell a parameter through which a server is handed a URL.
SSRF_WORDS = ["webhook", "callback", "proxy"]
SSRF_QUALIFIERS = ["target", "fetch", "source", "remote", "import", "external"]
#: A worker without a URL is the dynamic one of its document.
DYNAMIC = "__dynamic__"


def normal_form(rows: DataFrame, family: str, order: str) -> DataFrame:
    """One row per finding of a family, with the values of the last by ``order`` and the place of the first."""
    if family == "workers":
        rows = rows.withColumn("worker_url", F.coalesce("worker_url", F.lit(DYNAMIC)))
    return normalized(rows, NORMAL_KEYS[family], order)


def string_sets(sets: dict[str, Column | tuple[DataFrame, str]]) -> DataFrame:
    """(set_name, value): the distinct non-null values of each named (table, column)."""
    parts = [df.select(F.lit(name).alias("set_name"), F.col(c).alias("value")) for name, (df, c) in sets.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).where("value is not null").distinct()


def ssrf_shape(value: Column) -> Column:
    """Whether a name in a path or query hands the server a URL to fetch: a telling word, or url/uri with a qualifier."""
    names = F.regexp_extract_all(value, F.lit(r"[a-zA-Z_][a-zA-Z0-9_\-]*"), F.lit(0))

    def tells(name: Column) -> Column:
        w = X.words(name)
        return F.arrays_overlap(w, F.lit(SSRF_WORDS)) | F.arrays_overlap(w, F.lit(["url", "uri"])) & F.arrays_overlap(w, F.lit(SSRF_QUALIFIERS))

    return F.coalesce(F.exists(names, tells), F.lit(False))


def numeric_id_parameter(value: Column) -> Column:
    """Whether a query parameter with ``id`` among its words has a numeric value."""
    keys = F.regexp_extract_all(value, F.lit(r"[?&]([a-zA-Z_][a-zA-Z0-9_\-]*)=\d+"), F.lit(1))
    return F.coalesce(F.exists(keys, lambda k: F.array_contains(X.words(k), "id")), F.lit(False))


def document_streams(files: DataFrame, auth_only: DataFrame) -> DataFrame:
    """(file_id, url, stream): auth for scripts that need a session, then runtime, page and js.

    files (file_id, url, content, origin), auth_only (url). Which extractors see a document depends on its stream
    alone: links, forms and inline scripts are sought in pages, frameworks and script findings in all others.
    """
    auth = auth_only.select("url").distinct().withColumn("_auth", F.lit(True))
    page = F.coalesce(F.col("content").rlike(r"^\s*<"), F.lit(False))
    stream = F.when(F.col("_auth"), "auth").when(F.col("origin") == "runtime", "runtime").when(page, "page").otherwise("js")
    return files.select("file_id", "url", "content", "origin").join(auth, "url", "left").select("file_id", "url", stream.alias("stream"))


def retire_reports(reports: DataFrame, payload: str = "payload") -> DataFrame:
    """(id columns, file, name, version, cves): one row per vulnerability of a script scanner's report.

    The report is a list, or an object with the list as ``data``; anything else gives no rows.
    """
    entry = "array<struct<file:string,results:array<struct<component:string,version:string,vulnerabilities:array<struct<identifiers:struct<CVE:array<string>>>>>>>>"
    rest = [c for c in reports.columns if c != payload]
    listed = F.coalesce(F.from_json(payload, entry), F.from_json(payload, f"data {entry}")["data"])
    whole = F.when(F.col(payload).rlike(r"^\s*\{"), F.from_json(payload, f"data {entry}")["data"]).otherwise(listed)
    rows = reports.select(*rest, F.explode(whole).alias("e")).select(*rest, F.col("e.file").alias("file"), F.explode("e.results").alias("r"))
    rows = rows.select(*rest, "file", F.col("r.component").alias("name"), F.col("r.version").alias("version"), F.explode("r.vulnerabilities").alias("v"))
    return rows.select(*rest, "file", "name", "version", F.coalesce("v.identifiers.CVE", F.array().cast("array<string>")).alias("cves"))


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first of several sources that has any for a key; ``source_rank`` says which. All have equal columns."""
    every = reduce(lambda a, b: a.unionByName(b), [s.withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)])
    best = every.groupBy(key).agg(F.min("source_rank").alias("source_rank"))
    return every.join(best, [key, "source_rank"])


def entry_points(manifests: DataFrame) -> DataFrame:
    """(chunk_url): files of manifest entries whose name is not private, distinct."""
    entry = F.from_json("content", "map<string,struct<file:string>>")
    return manifests.select(F.explode(entry).alias("k", "v")).where("k <> '' and not startswith(k, '_') and v.file <> ''").select(F.col("v.file").alias("chunk_url")).distinct()


def phase_coverage(checks: DataFrame) -> DataFrame:
    """(phase, checks, coverage, passed) from (phase, status): share of PASS; passed if none is FAILED or unknown."""
    ok = F.coalesce(F.col("status").isin("PASS", "SKIPPED", "PARTIAL"), F.lit(False))
    return checks.groupBy("phase").agg(F.count(F.lit(1)).alias("checks"), (F.count_if(F.col("status") == "PASS") / F.count(F.lit(1))).alias("coverage"), F.bool_and(ok).alias("passed"))


def changed_runs(runs: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """(scan_run_id, has_changes) for every run: whether one of the fields has an item."""
    hit = changes.where(F.col("diff_field").isin(fields)).select("scan_run_id").distinct().withColumn("_hit", F.lit(True))
    return runs.select("scan_run_id").distinct().join(hit, "scan_run_id", "left").select("scan_run_id", F.coalesce("_hit", F.lit(False)).alias("has_changes"))


def change_lines(changes: DataFrame, wording: dict[str, str], listed: str) -> DataFrame:
    """(scan_run_id, part, text): the lines of a message on each run's changes, to be joined in the order (part, text).

    ``wording`` has a line with {n} for each diff field, in order; items of the field ``listed`` have a line each, so
    that no run's items are gathered in one row.
    """
    counts = changes.groupBy("scan_run_id", "diff_field").agg(F.count(F.lit(1)).alias("n"))
    at = F.create_map(*[F.lit(x) for k, f in enumerate(wording) for x in (f, 2 * k)])
    lines = F.create_map(*[F.lit(x) for kv in wording.items() for x in kv])
    known = counts.where(F.col("diff_field").isin(list(wording)))
    head = known.select("scan_run_id", at[F.col("diff_field")].alias("part"), F.replace(lines[F.col("diff_field")], F.lit("{n}"), F.col("n").cast("string")).alias("text"))
    items = changes.where(F.col("diff_field") == listed).select("scan_run_id", (at[F.col("diff_field")] + 1).alias("part"), F.concat(F.lit("  `"), F.coalesce("item", F.lit("")), F.lit("`")).alias("text"))
    return head.unionByName(items)


def seed_urls(urls: DataFrame, domains: DataFrame, decide) -> DataFrame:
    """(domain, url): URLs that are allowed one by one and whose host with its port is the domain."""
    allowed, _ = decide(F.col("url"))
    place = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return urls.where(allowed).select(place.alias("domain"), "url").distinct().join(domains.select("domain").distinct(), "domain")


def first_by(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, columns) of the first row of each key."""
    return rows.groupBy(key).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_b")).select(key, *[f"_b.{c}" for c in columns])


def evidence_lines(items: DataFrame) -> DataFrame:
    """(evidence_id, line): one line of an evidence listing per item; flagged ones say so."""
    flag = F.when(F.col("injection_suspected"), " [text may address the reader]").otherwise("")
    body = F.concat_ws(" ", F.concat(F.lit("- ["), F.col("evidence_id"), F.lit("]")), F.coalesce("pattern_name", F.lit("")), F.coalesce("value", F.lit("")), F.concat(F.lit("("), F.coalesce("source_url", F.lit("")), F.lit(")")))
    return items.select("evidence_id", F.concat(body, flag).alias("line"))


def candidate_files(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """(url, place): every non-null URL of the sources once, with the first source that names it."""
    parts = [df.select(F.col(c).alias("url"), F.lit(k).alias("place")) for k, (df, c) in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b), parts).where("url is not null").groupBy("url").agg(F.min("place").alias("place"))


#: A signed token with a header, claims and an optional signature.
JWT = r"eyJ[\w-]{6,}\.[\w-]{6,}\.[\w-]*"


def unsigned_tokens(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, partial_hash, severity): tokens whose decoded header names the algorithm none, any case.

    One row per document and token; a header that is not base64 of JSON is no case.
    """
    token = docs.where(F.col("content").contains("eyJ")).select("file_id", F.col("url").alias("source_url"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(JWT), F.lit(0)))).alias("t"))
    head = F.translate(F.substring_index("t", ".", 1), "-_", "+/")
    padded = F.concat(head, F.repeat(F.lit("="), F.pmod(-F.length(head), F.lit(4)).cast("int")))
    alg = F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.alg")
    return token.where(F.lower(alg) == "none").select("file_id", "source_url", F.substring(F.sha2("t", 256), 1, 12).alias("partial_hash"), F.lit("critical").alias("severity"))
