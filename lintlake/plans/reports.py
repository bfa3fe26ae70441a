"""Queries of normal forms, routing, lookups, word lists, messages and counters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import patterns as P
from lintlake.operators import extract as E
from lintlake.operators import process as R
from lintlake.operators import report as O
from lintlake.plans import duck as D
from lintlake.plans import reference as ref
from lintlake.plans import training
from lintlake.plans.corpus import DOCS_SQL, documents
from lintlake.sources import scope as S
from lintlake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        n = name or f.__name__
        QUERIES[n], ORACLES[n] = f, sql
        return f

    return add


def _with_docs(sql: str) -> str:
    return f"with {DOCS_SQL}\n{sql}"


# normal forms of the families that documents give; the order is the document's number
FROM_DOCS = "subdomains parameters dom_findings cors entropy_tokens comments feature_flags dependencies symbols graphql_ops websockets auth_findings proto_pollution postmessage workers".split()


def _normal(family: str) -> None:
    keys = O.NORMAL_KEYS[family]
    inner = ref.ORACLES[family]
    named = ", ".join(f"coalesce({k}, '{O.DYNAMIC}') as {k}" if k == "worker_url" else f'"{k}"' for k in keys)

    @query(f"select {', '.join(f'"{k}"' for k in keys)}, max(file_id) as last_order, min(file_id) as first_order from (select {named}, file_id from ({inner})) group by all", f"normal_{family}")
    def run(spark, d):
        rows = O.normal_form(ref.QUERIES[family](spark, d), family, "file_id")
        return rows.select(*keys, F.col("file_id").alias("last_order"), "first_order")


for _f in FROM_DOCS:
    _normal(_f)


@query("select url, arg_max(row(discovered_via_session, recovered_from_source_map), k)[1] as discovered_via_session, count(*) as copies from (select *, row(coalesce(source_map_found, false), coalesce(source_map_url, ''), coalesce(discovered_via_session, ''), coalesce(recovered_from_source_map, false)) as k from file_analysis) group by url")
def normal_files(spark, d):
    """Files of the analysis table; rows have no order of their own, so the greatest by its columns stands for all."""
    f = table(spark, d, "file_analysis")
    k = F.struct(F.coalesce("source_map_found", F.lit(False)).alias("a"), F.coalesce("source_map_url", F.lit("")).alias("b"), F.coalesce("discovered_via_session", F.lit("")).alias("c"), F.coalesce("recovered_from_source_map", F.lit(False)).alias("d"))
    best = f.withColumn("_k", k).groupBy("url").agg(F.max(F.struct("_k", "discovered_via_session")).alias("b"), F.count(F.lit(1)).alias("copies"))
    return best.select("url", F.col("b.discovered_via_session").alias("discovered_via_session"), "copies")


_OK, _WHY = ref._scope_sql("url")


@query(
    f"""select distinct * from (select 'targets' as set_name, target as value from scan_runs union all select 'collected_urls', url from (select url, {_OK} as ok from fetched_files) where ok
union all select 'denied_urls', url from (select url, {_OK} as ok from fetched_files) where not ok union all select 'auth_only_js_urls', unnest(auth_only_js_urls) from scan_runs
union all select 'historical_endpoint_values', value from snapshot_endpoints union all select 'runtime_confirmed_paths', regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) from fetched_files where origin = 'runtime') where value is not null"""
)
def normal_string_sets(spark, d):
    runs, files = table(spark, d, "scan_runs"), table(spark, d, "fetched_files").select("url", "origin")
    allowed, _ = S.decide(ref.SCOPE)(F.col("url"))
    paths = files.where("origin = 'runtime'").select(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"))
    return O.string_sets({
        "targets": (runs, "target"), "collected_urls": (files.where(allowed), "url"), "denied_urls": (files.where(~allowed), "url"),
        "auth_only_js_urls": (runs.select(F.explode("auth_only_js_urls").alias("url")), "url"), "historical_endpoint_values": (table(spark, d, "snapshot_endpoints"), "value"), "runtime_confirmed_paths": (paths, "path"),
    })


_TOKENS = "list_filter(list_transform(string_split_regex(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-$ ]'), lambda x: lower(x)), lambda x: x <> '')"


@query(
    f"""select endpoint_id, coalesce(list_bool_or(list_transform(regexp_extract_all(value, '[a-zA-Z_][a-zA-Z0-9_\\-]*'), lambda n: list_has_any({_TOKENS.format('n')}, {O.SSRF_WORDS!r})
  or list_has_any({_TOKENS.format('n')}, ['url', 'uri']) and list_has_any({_TOKENS.format('n')}, {O.SSRF_QUALIFIERS!r}))), false) as ssrf_shape from endpoints"""
)
def ssrf_shape(spark, d):
    return table(spark, d, "endpoints").select("endpoint_id", O.ssrf_shape(F.col("value")).alias("ssrf_shape"))


@query(f"select endpoint_id, coalesce(list_bool_or(list_transform(regexp_extract_all(value, '[?&]([a-zA-Z_][a-zA-Z0-9_\\-]*)=\\d+', 1), lambda n: list_contains({_TOKENS.format('n')}, 'id'))), false) as numeric_id from endpoints")
def numeric_id_parameter(spark, d):
    return table(spark, d, "endpoints").select("endpoint_id", O.numeric_id_parameter(F.col("value")).alias("numeric_id"))


@query(f"select distinct url as value from (select url, {_OK} as ok from fetched_files) where ok")
def wordlist_urls(spark, d):
    allowed, _ = S.decide(ref.SCOPE)(F.col("url"))
    return table(spark, d, "fetched_files").where(allowed).select(F.col("url").alias("value")).distinct()


@query(f"select distinct name as value from ({ref.ORACLES['parameters']})")
def wordlist_parameters(spark, d):
    return E.parameters(documents(spark, d)).select(F.col("name").alias("value")).distinct()


@query(f"select distinct domain as value from ({ref.ORACLES['subdomains']}) where in_scope")
def wordlist_subdomains(spark, d):
    """Only domains in scope; those flagged for review stay out."""
    return E.subdomains(documents(spark, d), ref.SCOPE.bases, S.decide(ref.SCOPE)).where("in_scope").select(F.col("domain").alias("value")).distinct()


@query(f"select distinct hostname as value from ({ref.ORACLES['third_party_scripts']})")
def wordlist_third_party_hosts(spark, d):
    return ref.QUERIES["third_party_scripts"](spark, d).select(F.col("hostname").alias("value")).distinct()


@query(_with_docs(
    r"""select file_id, source_url, substr(sha256(t), 1, 12) as partial_hash, 'critical' as severity from (
  select distinct file_id, url as source_url, unnest(regexp_extract_all(content, 'eyJ[\w-]{6,}\.[\w-]{6,}\.[\w-]*')) as t from docs)
where lower(try(json_extract_string(decode(try(from_base64(rpad(translate(split_part(t, '.', 1), '-_', '+/'), cast(ceil(length(split_part(t, '.', 1)) / 4.0) * 4 as int), '=')))), '$.alg'))) = 'none'"""
))
def jwt_alg_none(spark, d):
    return O.unsigned_tokens(documents(spark, d))


#: A scope listing as its authors write it.
LISTING = "# targets\n*.harborloom.example\n  app.veltrona.example  \n!cdn.harborloom.example\n\n! *.b3.shop.example.com\n"


@query("select * from (values ('*.harborloom.example', 'wildcard', true), ('app.veltrona.example', 'exact', true), ('cdn.harborloom.example', 'exact', false), ('*.b3.shop.example.com', 'wildcard', false)) t(pattern, match_type, included)")
def scope_txt(spark, d):
    """The patterns of a scope listing."""
    s = S.parse_text(LISTING)
    rows = [(p, "wildcard" if p.startswith("*.") else "exact", kept) for kept, ps in ((True, s.included), (False, s.excluded)) for p in ps]
    return spark.createDataFrame(rows, "pattern string, match_type string, included boolean")


_STREAM = """(select file_id, url, content, case when url in (select unnest(auth_only_js_urls) from scan_runs) then 'auth' when origin = 'runtime' then 'runtime' when regexp_matches(content, '^\\s*<') then 'page' else 'js' end as stream from fetched_files)"""


def _streams(spark, d):
    auth = table(spark, d, "scan_runs").select(F.explode("auth_only_js_urls").alias("url"))
    return O.document_streams(table(spark, d, "fetched_files"), auth)


@query(f"select file_id, url, stream from {_STREAM}")
def document_streams(spark, d):
    return _streams(spark, d)


@query(f"select stream, count(*) as documents, count(distinct url) as urls from {_STREAM} group by 1")
def stream_counts(spark, d):
    return _streams(spark, d).groupBy("stream").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("url").alias("urls"))


@query(f"select distinct url as source_url, name as pattern_name, value from {D.hits('(select distinct url as content, url, 0 as file_id from (select url from fetched_files union all select \'https://app.example\' || value from endpoints where starts_with(value, \'/\')))', P.ENDPOINTS)} where value <> ''")
def url_endpoints(spark, d):
    """Endpoints in the URLs themselves, a stream of its own beside their bodies."""
    more = table(spark, d, "endpoints").where(F.col("value").startswith("/")).select(F.concat(F.lit("https://app.example"), "value").alias("url"))
    urls = table(spark, d, "fetched_files").select("url").unionByName(more).distinct().select(F.lit(0).cast("bigint").alias("file_id"), "url", F.col("url").alias("content"))
    return E.endpoints(urls).select("source_url", "pattern_name", "value")


_RETIRE = (
    "concat('[{\"file\": \"a', p_partkey, '.js\", \"results\": [{\"component\": \"lib', p_partkey % 7, '\", \"version\": \"1.', p_partkey % 5, '\", \"vulnerabilities\": [{\"identifiers\": {\"CVE\": [\"CVE-2020-', p_partkey, '\"]}}, {\"severity\": \"low\"}]}, {\"component\": \"x\"}]}]')"
)
_RETIRED = "select p_partkey, 'a' || p_partkey || '.js' as file, 'lib' || p_partkey % 7 as name, '1.' || p_partkey % 5 as version, unnest([['CVE-2020-' || p_partkey], []::varchar[]]) as cves from part where p_partkey % 6 > 0"


def _retired(spark, d):
    payload = F.expr(f"case p_partkey % 6 when 0 then 'no report' when 1 then concat('{{\"data\": ', {_RETIRE}, '}}') else {_RETIRE} end")
    return O.retire_reports(table(spark, d, "part").select("p_partkey", payload.alias("payload")))


@query(_RETIRED)
def retire_flatten(spark, d):
    """Script scanner reports made of parts, flattened."""
    return _retired(spark, d)


@query(
    f"""with osv as (select p_partkey % 10 as scan, 'osv' || p_partkey as name from part where p_partkey % 10 < 3), retire as (select p_partkey % 10 as scan, name from ({_RETIRED}) where p_partkey % 10 < 6),
banner as (select p_partkey % 10 as scan, 'banner' || p_partkey as name from part)
select scan, name, 0 as source_rank from osv union all select scan, name, 1 from retire where scan not in (select scan from osv) union all select scan, name, 2 from banner where scan not in (select scan from osv union select scan from retire)"""
)
def dependency_priority(spark, d):
    """Per scan the lock-file report, else the script scanner's, else banners."""
    p = table(spark, d, "part")
    scan = (F.col("p_partkey") % 10).alias("scan")
    osv = p.where("p_partkey % 10 < 3").select(scan, F.concat(F.lit("osv"), "p_partkey").alias("name"))
    retire = _retired(spark, d).where("p_partkey % 10 < 6").select(scan, "name")
    return O.first_source([osv, retire, p.select(scan, F.concat(F.lit("banner"), "p_partkey").alias("name"))], "scan").select("scan", "name", "source_rank")


_MANIFESTS = "(select content from docs where starts_with(content, '{') and contains(content, '\"dynamicImports\"') and json_valid(content))"


@query(_with_docs(f"select distinct json_extract_string(content, '$.\"' || k || '\".file') as chunk_url from (select content, unnest(json_keys(content)) as k from {_MANIFESTS}) where not starts_with(k, '_') and json_extract_string(content, '$.\"' || k || '\".file') <> ''"))
def entry_points(spark, d):
    docs = documents(spark, d).where(F.col("content").startswith("{") & F.col("content").contains('"dynamicImports"'))
    return O.entry_points(docs)


@query(
    f"""select 'Targets' as label, count(distinct target) as value from scan_runs union all select 'URLs collected', count(distinct url) from (select url, {_OK} as ok from fetched_files) where ok
union all select 'JS files', count(distinct url) from file_analysis union all select 'Endpoints', count(*) from (select distinct pattern_name, value, source_url from endpoints)
union all select 'Secrets', count(*) from (select distinct secret_type, partial_hash, source_url from snapshot_secrets) union all select 'Subdomains', count(*) from (select distinct domain, source_url from ({ref.ORACLES['subdomains']}))
union all select 'CORS misconfigurations', count(distinct source_url) from ({ref.ORACLES['cors']}) union all select 'Third-party scripts', count(*) from (select distinct hostname, script_url from ({ref.ORACLES['third_party_scripts']}))"""
)
def report_tiles(spark, d):
    docs = documents(spark, d)
    allowed, _ = S.decide(ref.SCOPE)(F.col("url"))
    sets = {
        "Targets": table(spark, d, "scan_runs").select("target"), "URLs collected": table(spark, d, "fetched_files").where(allowed).select("url"), "JS files": table(spark, d, "file_analysis").select("url"),
        "Endpoints": table(spark, d, "endpoints").select(O.NORMAL_KEYS["endpoints"]), "Secrets": table(spark, d, "snapshot_secrets").select(O.NORMAL_KEYS["secrets"]),
        "Subdomains": E.subdomains(docs, ref.SCOPE.bases, S.decide(ref.SCOPE)).select("domain", "source_url"), "CORS misconfigurations": E.cors(docs).select("source_url"),
        "Third-party scripts": ref.QUERIES["third_party_scripts"](spark, d).select("hostname", "script_url"),
    }
    parts = [df.distinct().agg(F.count(F.lit(1)).alias("value")).select(F.lit(label).alias("label"), "value") for label, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CHECKS = "(select event_type as phase, case event_id % 97 when 0 then 'FAILED' when 1 then 'SKIPPED' when 2 then 'PARTIAL' else 'PASS' end as status from events where event_type <> 'purchase' or event_id % 97 > 0)"


@query(f"select phase, count(*) as checks, count(*) filter (status = 'PASS') / count(*) as coverage, bool_and(status <> 'FAILED') as passed from {_CHECKS} group by 1")
def phase_coverage(spark, d):
    status = F.expr("case event_id % 97 when 0 then 'FAILED' when 1 then 'SKIPPED' when 2 then 'PARTIAL' else 'PASS' end")
    checks = table(spark, d, "events").where("event_type <> 'purchase' or event_id % 97 > 0").select(F.col("event_type").alias("phase"), status.alias("status"))
    return O.phase_coverage(checks)


# The diff fields that count as a change worth a message, with the line for each, in order.
WORDING = {
    "access_control_regressions": "{n} access-control regression(s): reachable without a session now",
    "new_endpoints": "+{n} new endpoint(s)",
    "removed_endpoints": "-{n} removed endpoint(s)",
    "new_secrets": "+{n} new secret(s) (type:hash only)",
    "removed_secrets": "-{n} removed secret(s)",
}


@query(training._P1 + f"select distinct r.scan_run_id, f.scan_run_id is not null as has_changes from scan_runs r left join (select distinct scan_run_id from found where diff_field in {tuple(WORDING)!r}) f on f.scan_run_id = r.scan_run_id")
def changed_runs(spark, d):
    return O.changed_runs(table(spark, d, "scan_runs"), training.p1_found(spark, d), list(WORDING))


@query(
    training._P1 + "select scan_run_id, cast(case diff_field " + " ".join(f"when '{f}' then {2 * k}" for k, f in enumerate(WORDING)) + " end as int) as part, replace(case diff_field " + " ".join(f"when '{f}' then '{w}'" for f, w in WORDING.items())
    + f" end, '{{n}}', cast(count(*) as varchar)) as text from found where diff_field in {tuple(WORDING)!r} group by scan_run_id, diff_field union all select scan_run_id, 1, '  `' || coalesce(item, '') || '`' from found where diff_field = 'access_control_regressions'"
)
def change_messages(spark, d):
    return O.change_lines(training.p1_found(spark, d), WORDING, "access_control_regressions")


@query(f"select distinct regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as domain, url from (select url, {_OK} as ok from {ref._URLS}) where ok and regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) in (select regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) from endpoints)")
def seed_urls(spark, d):
    t = table(spark, d, "endpoints").select(F.regexp_extract("source_url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("domain"))
    return O.seed_urls(ref._urls(spark, d), t, S.decide(ref.SCOPE))


_EID = "substr(sha256(coalesce(pattern_name, '') || ':' || coalesce(value, '') || ':' || coalesce(source_url, '')), 1, 16)"
_ITEMS = ref.ORACLES["evidence_items"]


@query(f"select * from ({_ITEMS}) where evidence_id in (select {_EID} from endpoints where tag = 'auth-required')")
def evidence_by_id(spark, d):
    """Evidence items that are asked for by id."""
    from lintlake.functions import text as X

    asked = table(spark, d, "endpoints").where("tag = 'auth-required'").select(X.stable_id(F.col("pattern_name"), F.col("value"), F.col("source_url")).alias("evidence_id")).distinct()
    return R.evidence_items(table(spark, d, "endpoints")).join(asked, "evidence_id", "left_semi")


@query(f"select evidence_id, '- [' || evidence_id || '] ' || coalesce(pattern_name, '') || ' ' || coalesce(value, '') || ' (' || coalesce(source_url, '') || ')' || case when injection_suspected then ' [text may address the reader]' else '' end as line from ({_ITEMS})")
def evidence_lines(spark, d):
    return O.evidence_lines(R.evidence_items(table(spark, d, "endpoints")))


@query(
    f"""select i.evidence_id, v.tag as priority, v.first_id as verdict_from from ({_ITEMS}) i left join (select {_EID} as evidence_id, min(endpoint_id) as first_id, arg_min(coalesce(tag, ''), endpoint_id) as tag from endpoints where environment is not null group by 1) v on v.evidence_id = i.evidence_id"""
)
def verdict_lookup(spark, d):
    """Every evidence item with the first verdict on it, if any; endpoints with an environment stand for verdicts."""
    from lintlake.functions import text as X

    v = table(spark, d, "endpoints").where("environment is not null").select(X.stable_id(F.col("pattern_name"), F.col("value"), F.col("source_url")).alias("evidence_id"), "endpoint_id", F.coalesce("tag", F.lit("")).alias("tag"))
    first = O.first_by(v, "evidence_id", ["endpoint_id"], ["endpoint_id", "tag"])
    return R.evidence_items(table(spark, d, "endpoints")).select("evidence_id").join(first, "evidence_id", "left").select("evidence_id", F.col("tag").alias("priority"), F.col("endpoint_id").alias("verdict_from"))


@query("select e.endpoint_id, l.label from endpoints e left join (select url, min(discovered_via_session) as label from file_analysis where discovered_via_session is not null group by 1) l on l.url = e.source_url")
def session_labels(spark, d):
    labels = table(spark, d, "file_analysis").where("discovered_via_session is not null").groupBy(F.col("url").alias("source_url")).agg(F.min("discovered_via_session").alias("label"))
    return table(spark, d, "endpoints").select("endpoint_id", "source_url").join(labels, "source_url", "left").select("endpoint_id", "label")


@query("select cast(ceil(count(*) / 20.0) as bigint) as batches from endpoints")
def batch_count(spark, d):
    return table(spark, d, "endpoints").agg(F.ceil(F.count(F.lit(1)) / 20).alias("batches"))


_SRC_OK = ref._scope_sql("source_url")[0]


@query(f"select endpoint_id, value, source_url from (select *, {_SRC_OK} as ok from endpoints) where ok")
def endpoints_in_scope(spark, d):
    allowed, _ = S.decide(ref.SCOPE)(F.col("source_url"))
    return table(spark, d, "endpoints").where(allowed).select("endpoint_id", "value", "source_url")


@query("select url, min(place) as place from (select url, 0 as place from fetched_files union all select source_url, 1 from endpoints union all select source_url, 2 from snapshot_secrets) where url is not null group by 1")
def candidate_files(spark, d):
    return O.candidate_files([(table(spark, d, "fetched_files"), "url"), (table(spark, d, "endpoints"), "source_url"), (table(spark, d, "snapshot_secrets"), "source_url")])
