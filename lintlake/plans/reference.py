"""Queries of the engine's own operators over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import patterns as P
from lintlake.functions import text as X
from lintlake.functions.text import Pattern
from lintlake.operators import extract as E
from lintlake.operators import process as R
from lintlake.plans import duck as D
from lintlake.plans.corpus import DOCS_SQL, documents, pages
from lintlake.sources import scope as S
from lintlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The scope that the scope queries decide by.
SCOPE = S.Scope(
    ("*.harborloom.example", "app.veltrona.example", "*.shop.example.com", "corpus.example.com"), ("cdn.harborloom.example", "*.b3.shop.example.com"), ("/static/*", "*/vendors/*", "/app/ws*")
)


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.lstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = "with " + DOCS_SQL + "\n" + sql if "docs" in sql or "pages" in sql else sql
        return f

    return add


# extractors -------------------------------------------------------------------------------------------------------


@query(f"select distinct file_id, url as source_url, name as pattern_name, value from {D.hits('docs', P.ENDPOINTS)} where value <> ''")
def endpoints_docs(spark, d):
    return E.endpoints(documents(spark, d))


@query(f"select file_id, url, {D.names_where(sorted(P.FRAMEWORKS, key=lambda p: p.name))} as frameworks from docs")
def frameworks(spark, d):
    return E.frameworks(documents(spark, d))


_WORDS = "list_filter(list_transform(string_split_regex(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-$ ]'), lambda x: lower(x)), lambda x: x <> '')"
_LINES = "string_split(content, chr(10))"
_FN = D.lit(P.FUNCTION_NAME)


@query(
    f"""select file_id, source_url, name, nullif(case when fl is null then null when regexp_extract(fl, {_FN}, 1) <> '' then regexp_extract(fl, {_FN}, 1) else regexp_extract(fl, {_FN}, 2) end, '') as function_name, line
from (select file_id, url as source_url, value as name, line, pat_ord, match_ord,
  list_filter(list_reverse(lines[greatest(1, line - {P.FUNCTION_REACH}):line]), lambda x: regexp_matches(x, {_FN}))[1] as fl,
  row_number() over (partition by file_id, url, value order by pat_ord, match_ord) as rn
  from (select h.*, {_LINES} as lines from {D.hits('docs', [P.DECLARED, P.QUERIED])} h join docs using (file_id))
  where list_has_any({_WORDS.format('value')}, {P.PARAMETER_WORDS!r})) where rn = 1"""
)
def parameters(spark, d):
    return E.parameters(documents(spark, d))


def _scope_sql(column: str) -> tuple[str, str]:
    host, path = D.HOST.format(column), D.PATH.format(column)

    def match(p: str) -> str:
        return f"({host} = {D.lit(p[2:])} or ends_with({host}, {D.lit(p[1:])}))" if p.startswith("*.") else f"{host} = {D.lit(p)}"

    out, hit = (" or ".join(map(match, x)) for x in (SCOPE.excluded, SCOPE.included))
    bad = " or ".join(f"{path} glob {D.lit(p)}" for p in SCOPE.excluded_paths)
    reason = f"case when {out} then 'out-of-scope: ' || {host} when not ({hit}) then 'not in scope: ' || {host} when {bad} then 'excluded path: ' || {path} else 'in scope' end"
    return f"coalesce(not ({out}) and ({hit}) and not ({bad}), false)", reason


_SUB = " union ".join(
    f"select file_id, url as source_url, lower(unnest(regexp_extract_all(content, {D.lit('(?i)(?:' + P.LABEL + ')(?:[.]' + P.LABEL + ')*[.]' + b.replace('.', '[.]') + chr(92) + 'b')}, 0))) as domain from docs" for b in SCOPE.bases
)
_OK, _WHY = _scope_sql("domain")


@query(f"select *, case when in_scope then 'in scope: ' else 'discovered, flagged for manual review: ' end || {_WHY} as note from (select *, {_OK} as in_scope from ({_SUB}))")
def subdomains(spark, d):
    return E.subdomains(documents(spark, d), SCOPE.bases, S.decide(SCOPE))


@query(
    f"""select file_id, url as file, nm as name, kind, line from (select *, row_number() over (partition by file_id, url, nm order by pat_ord, match_ord, part) as rn from (
  select file_id, url, pat_ord, match_ord, line, name as kind, unnest(names) as nm, unnest(range(len(names))) as part from (
  select *, case when starts_with(text, 'export') and contains(text, '{{') then regexp_extract_all(value, {D.lit(P.NAME)}) else [value] end as names from {D.hits('docs', P.SYMBOLS)}))) where rn = 1"""
)
def symbols(spark, d):
    return E.symbols(documents(spark, d))


@query(
    f"""select file_id, url as source_url, substr(clean, 1, 200) as text, line, kw as keyword_matched from (
  select *, row_number() over (partition by file_id, url, substr(clean, 1, 120), kw order by pat_ord, match_ord, part) as rn from (
    select file_id, url, pat_ord, match_ord, part, line + part as line, {D.lower_trim('c')} as clean, unnest(list_filter({sorted(P.COMMENT_WORDS)!r}, lambda k: contains(lower(c), k))) as kw from (
      select *, unnest(ls) as c, unnest(range(len(ls))) as part from (select *, case when name = 'block' then string_split(value, chr(10)) else [value] end as ls from {D.hits('docs', [P.LINE_COMMENT, P.BLOCK_COMMENT])})))) where rn = 1"""
)
def comments(spark, d):
    return E.comments(documents(spark, d))


def _nth_start(patterns: list[Pattern], column: str = "content") -> str:
    """Position of match number ``match_ord`` of pattern ``pat_ord``."""
    return "case pat_ord " + " ".join(
        f"when {k} then 1 + length(array_to_string(string_split_regex({column}, {D.rx(p)})[1:match_ord], '') || array_to_string(regexp_extract_all({column}, {D.rx(p)}, 0)[1:match_ord-1], ''))" for k, p in enumerate(patterns)
    ) + " end"


@query(
    f"""select file_id, url as source_url, key, value_hint, line from (select *, row_number() over (partition by file_id, url, key, line order by pat_ord, match_ord) as rn from (
  select *, case when regexp_extract(snip, {D.lit(P.FLAG_KEY)}, 1) <> '' then regexp_extract(snip, {D.lit(P.FLAG_KEY)}, 1) else substr(text, 1, 40) end as key,
    regexp_extract(substr(snip, length(text) + 1), {D.lit(P.FLAG_VALUE)}, 0) as value_hint
  from (select h.*, substr(content, {_nth_start(P.FLAGS)}, {P.FLAG_SNIPPET}) as snip from {D.hits('docs', P.FLAGS)} h join docs using (file_id)))) where rn = 1"""
)
def feature_flags(spark, d):
    return E.feature_flags(documents(spark, d))


_GQL_EP = f"coalesce(nullif(regexp_extract(content, {D.lit(P.GQL_ENDPOINT)}, 1), ''), nullif(regexp_extract(content, {D.lit(P.GQL_ENDPOINT_FETCH)}, 1), ''), '/graphql')"
_OP = D.rx(P.GQL_OPERATION)
_GQL = f"""with ops as (
  select file_id, url, 0 as pass, match_ord, part, line, value as body, case when n > 0 then lower(regexp_extract(o, '^(\\w+)', 1)) else 'unknown' end as op_type,
    case when n > 0 then regexp_extract(o, {_OP}, 1) else 'anonymous_' || line end as op_name, '' as persisted_hash
  from (select *, len(os) as n, unnest(case when len(os) > 0 then os when trim(value) <> '' then [''] end) as o, unnest(range(greatest(len(os), 1))) as part
    from (select *, regexp_extract_all(value, {_OP}, 0) as os from {D.hits('docs', [P.GQL_TEMPLATE])})) where o is not null
  union all
  select file_id, url, 1, match_ord, 0, line, substr(content, {_nth_start([P.GQL_OPERATION])}, 500), lower(regexp_extract(text, '^(\\w+)', 1)), value, '' from {D.hits('docs', [P.GQL_OPERATION])} h join docs using (file_id, url)
  union all
  select file_id, url, 2, match_ord, 0, line, '', 'persisted', 'persisted_' || substr(value, 1, 16), value from {D.hits('docs', [P.GQL_PERSISTED])}),
gql as (select o.file_id, o.url as source_url, op_type, op_name, {_GQL_EP} as endpoint, list_distinct_ordered(regexp_extract_all(body, {D.lit(P.GQL_VARIABLE)}, 1)) as variables,
  list_distinct_ordered(regexp_extract_all(body, {D.lit(P.GQL_FIELD)}, 1)) as fields, line, persisted_hash <> '' as is_persisted, persisted_hash
  from (select *, row_number() over (partition by file_id, url, op_type, op_name order by pass, match_ord, part) as rn from ops) o join docs using (file_id) where rn = 1)"""


def _ordered_distinct(sql: str) -> str:
    """``list_distinct_ordered(x)`` written out: the first of each value in order."""
    import re

    mark = "list_distinct_ordered("
    while mark in sql:
        head, _, rest = sql.rpartition(mark)  # the last one holds no other
        depth, k, quoted = 1, 0, False
        while depth:
            ch = rest[k]
            if ch == "'":
                quoted = not quoted
            if not quoted:
                depth += (ch == "(") - (ch == ")")
            k += 1
        inner = rest[: k - 1]
        sql = f"{head}list_filter({inner}, lambda x, i: list_position({inner}, x) = i){rest[k:]}"
    return re.sub(r"^with ", "", sql, count=1)


_GQL = _ordered_distinct(_GQL)
_GQL_HEAD = "with " + DOCS_SQL + ",\n" + _GQL


@query()
def graphql_ops(spark, d):
    return E.graphql_operations(documents(spark, d))


ORACLES["graphql_ops"] = _GQL_HEAD + " select * from gql"


@query(f"select file_id, url from docs where {' or '.join(D.has(p) for p in P.GQL_CLIENTS)}")
def graphql_clients(spark, d):
    return E.graphql_clients(documents(spark, d))


@query()
def graphql_risk(spark, d):
    return E.graphql_risk(E.graphql_operations(documents(spark, d)))


ORACLES["graphql_risk"] = _GQL_HEAD + f""", r as (select *, list_filter(variables, lambda v: list_contains({P.GQL_OWNER_IDS!r}, regexp_replace(lower(v), 's+$', ''))) as owners,
  list_filter(fields, lambda f: list_contains({P.GQL_SENSITIVE_FIELDS!r}, lower(f))) as sens from gql)
select file_id, op_type, op_name, 'sensitive_mutation' as risk, op_name as detail from r where op_type = 'mutation' and ({' or '.join(f"contains(lower(op_name), '{w}')" for w in P.GQL_SENSITIVE_OPERATIONS)})
union all select file_id, op_type, op_name, 'owner_ids', array_to_string(owners, ',') from r where len(owners) > 0
union all select file_id, op_type, op_name, 'sensitive_fields', array_to_string(sens, ',') from r where len(sens) > 0"""

_WS_ACTIONS = "list_concat(list_concat(" + ", ".join(f"list_distinct_ordered({D.values(p)})" for p in P.WS_ACTIONS[:2]) + f"), list_distinct_ordered({D.values(P.WS_ACTIONS[2])}))"
_WS = _ordered_distinct(
    f"""with wsb as (select *, list_distinct_ordered({_WS_ACTIONS}) as acts, list_distinct_ordered({D.values(P.WS_OBJECT_ID)}) as objs, {D.has(P.WS_ORIGIN)} as oc, {D.has(P.WEBSOCKETS[3])} as nio from docs
  where {' or '.join(D.has(p) for p in P.WEBSOCKETS)}),
wsr as (select *, case name when 'dynamic' then 'dynamic:' || substr({D.lower_trim('value')}, 1, 60) when 'socketio_default' then '/socket.io' when 'stomp' then '/stomp' when 'graphql-ws' then '/graphql' else value end as endpoint,
  case name when 'dynamic' then 'websocket' when 'socketio_default' then 'socketio' else name end as protocol
  from {D.hits('wsb', P.WEBSOCKETS, 'file_id, url, acts, objs, oc, nio')} where not (name = 'socketio_default' and nio) and (name not in ('socketio_default', 'stomp', 'graphql-ws') or match_ord = 1)),
ws as (select file_id, url as source_url, endpoint, protocol, regexp_matches(endpoint, {D.lit(P.WS_AUTH)}) as auth_in_url, acts[1:{P.WS_MOST_ACTIONS}] as message_actions, objs as object_ids, oc as has_origin_check, line
  from (select *, row_number() over (partition by file_id, url, endpoint, protocol order by pat_ord, match_ord) as rn from wsr) where rn = 1)"""
)


@query()
def websockets(spark, d):
    return E.websockets(documents(spark, d))


ORACLES["websockets"] = "with " + DOCS_SQL + ",\n" + _WS + " select * from ws"


@query()
def websocket_risk(spark, d):
    return E.websocket_risk(E.websockets(documents(spark, d)))


ORACLES["websocket_risk"] = "with " + DOCS_SQL + ",\n" + _WS + """ select file_id, endpoint, protocol, unnest(list_filter([case when auth_in_url then 'token_in_url' end,
  case when len(object_ids) > 0 and not has_origin_check then 'object_ids_unchecked' end, case when not has_origin_check and protocol in ('websocket', 'socketio') then 'no_origin_check' end], lambda x: x is not null)) as risk from ws"""

_AUTH_SQL = [p for p in P.AUTH if p.name != "jwt_decode_no_verify"]
_JWT = Pattern("jwt_decode_no_verify", r"(?:jwt_decode|jwtDecode|decode)\s*\(\s*[^,)]+\s*\)", 0, "i")
_AUTH = f"""with ah as (select file_id, url, pat_ord, match_ord, line, name, substr(case when starts_with(name, 'token_in_') and not ends_with(name, 'url') then value else text end, 1, 80) as detail from (
    select * from {D.hits('docs', [_JWT])} union all select * replace (pat_ord + 1 as pat_ord) from {D.hits('docs', _AUTH_SQL)}) where not (name in ({', '.join(map(repr, P.AUTH_FIRST_ONLY))}) and match_ord > 1)
  union all select file_id, url, 99, 1, 1, unnest(list_filter([case when not {D.has(P.STATE)} then 'oauth_missing_state' end, case when not {D.has(P.PKCE)} then 'oauth_missing_pkce' end], lambda x: x is not null)), ''
  from docs where content is not null and ({D.has(P.OAUTH_ENDPOINT)} or {D.has(P.AUTH[9])}))
select file_id, url as source_url, name as finding_type, detail, case when name = 'token_in_localstorage' and contains(lower(detail), 'refresh') then 'high' else {D.case_map('name', P.AUTH_SEVERITY)} end as severity_candidate, line
from (select *, row_number() over (partition by file_id, url, name, line order by pat_ord, match_ord) as rn from ah) where rn = 1"""


@query()
def auth_findings(spark, d):
    return E.auth_findings(documents(spark, d))


ORACLES["auth_findings"] = "with " + DOCS_SQL + ",\n" + _AUTH.removeprefix("with ")

_DOM_SOURCES = D.names_where(sorted(P.DOM_SOURCES, key=lambda p: p.name))
_DOM = " union all ".join(
    f"select file_id, url as source_url, {D.lit(p.name)} as sink_pattern, regexp_extract(content, {D.rx(p)}, 0) as sink_value, {_DOM_SOURCES} as co_occurring_sources from docs where {D.has(p)}" for p in P.DOM_SINKS
)


@query(f"select * from ({_DOM}) where len(co_occurring_sources) > 0")
def dom_findings(spark, d):
    return E.dom_findings(documents(spark, d))


@query()
def dom_taint(spark, d):
    return E.dom_taint(documents(spark, d))


@query()
def taint_risk(spark, d):
    return E.taint_risk(E.dom_taint(documents(spark, d)))


_LEVELS = " ".join(f"when {k} then {n}" for k, (n, _) in enumerate(P.PROTO))
_PROTO = f"""with pp as (select file_id, url as source_url, case pat_ord {_LEVELS} end as level, name as pattern_name, gadgets, line from (
  select *, row_number() over (partition by file_id, url, name, line order by match_ord) as rn from {D.hits('pb', [p for _, p in P.PROTO], 'file_id, url, gadgets')}) where rn = 1)"""
_PB = f"pb as (select *, {D.names_where(P.GADGETS)} as gadgets from docs where content is not null)"


@query()
def proto_pollution(spark, d):
    return E.proto_pollution(documents(spark, d)).drop("detail")


ORACLES["proto_pollution"] = "with " + DOCS_SQL + ",\n" + _PB + ",\n" + _PROTO.removeprefix("with ") + " select * from pp"


@query()
def proto_risk(spark, d):
    return E.proto_risk(E.proto_pollution(documents(spark, d)))


ORACLES["proto_risk"] = "with " + DOCS_SQL + ",\n" + _PB + ",\n" + _PROTO.removeprefix("with ") + """ select source_url, max(level) as max_level, count(*) filter (level = 5) as writes, count(*) filter (level = 3) as merges,
  count(*) filter (level = 4) as dynamic_writes, list_sort(list_distinct(flatten(list(gadgets)))) as gadgets from pp group by 1"""

_AROUND = f"array_to_string(string_split(content, chr(10))[greatest(1, line - {P.POST_REACH}):line + {P.POST_REACH}], chr(10))"
_PM = f"""with pr as (select * from (select *, row_number() over (partition by file_id, url, name, line order by match_ord) as rn from {D.hits('docs', [P.POST_SEND, P.POST_LISTEN])}) where rn = 1),
pa as (select pr.*, case when name = 'receiver' then {_AROUND} end as around from pr join docs using (file_id)),
pm as (select file_id, url as source_url, name as kind, case when name = 'sender' then nullif(regexp_replace(value, '^[''"` ]+|[''"` ]+$', '', 'g'), '') end as target_origin,
  {D.has(P.POST_ORIGIN, 'around')} as has_origin_check, {D.names_where(P.POST_SINKS, 'around')} as data_sinks, line from pa)"""


@query()
def postmessage(spark, d):
    return E.postmessage(documents(spark, d))


ORACLES["postmessage"] = "with " + DOCS_SQL + ",\n" + _PM.removeprefix("with ") + " select * from pm"


@query()
def postmessage_risk(spark, d):
    return E.postmessage_risk(E.postmessage(documents(spark, d)))


ORACLES["postmessage_risk"] = "with " + DOCS_SQL + ",\n" + _PM.removeprefix("with ") + """ select source_url, count(*) filter (kind = 'sender' and target_origin = '*') as wildcard_senders,
  count(*) filter (kind = 'receiver' and not has_origin_check) as unchecked_receivers, list_sort(list_distinct(flatten(list(data_sinks)))) as sinks from pm group by 1"""

_WK = f"""with wb as (select *, flatten(list_transform({D.values(P.IMPORT_SCRIPTS)}, lambda c: regexp_extract_all(c, {D.lit(P.QUOTED_URL)}, 1))) as urls, {D.has(P.WORKER_FETCH)} as fe, {D.has(P.WORKER_SKIP)} as sk, {D.has(P.WORKER_CLAIM)} as cl from docs),
wr as (select *, name in ('service_worker', 'web_worker', 'shared_worker') as literal from {D.hits('wb', P.WORKERS, 'file_id, url, urls, fe, sk, cl')}),
wk as (select file_id, url as source_url, case name when 'service_worker_dynamic' then 'service_worker' when 'blob_worker' then 'web_worker' else name end as worker_type, case when literal then value end as worker_url,
  name like 'service%' and fe as has_fetch_intercept, len(urls) > 0 as has_importscripts, urls as importscripts_urls, name = 'blob_worker' as is_inline_blob, name like 'service%' and sk as has_skip_waiting, name like 'service%' and cl as has_clients_claim, line
  from (select *, row_number() over (partition by file_id, url, name, case when literal then value else '' end order by pat_ord, match_ord) as rn from wr) where rn = 1)"""


@query()
def workers(spark, d):
    return E.workers(documents(spark, d))


ORACLES["workers"] = "with " + DOCS_SQL + ",\n" + _WK.removeprefix("with ") + " select * from wk"


@query()
def worker_risk(spark, d):
    return E.worker_risk(E.workers(documents(spark, d)))


ORACLES["worker_risk"] = "with " + DOCS_SQL + ",\n" + _WK.removeprefix("with ") + """ select source_url, count(*) filter (has_fetch_intercept) as intercepting, count(*) filter (worker_type = 'service_worker' and has_skip_waiting) as skip_waiting,
  count(*) filter (is_inline_blob) as blobs, list_sort(list_filter(list_distinct(flatten(list(importscripts_urls))), lambda u: starts_with(u, 'http'))) as external_imports from wk group by 1"""


@query(
    "select file_id, url as source_url, ' * ' as allow_origin from (select -p_partkey as file_id, url, open_cors from docs join (select -p_partkey as file_id, p_partkey, p_partkey % 5 = 0 as open_cors from part) using (file_id)) where open_cors "
    "union all select file_id, url, headers['access-control-allow-origin'] from fetched_files where trim(headers['access-control-allow-origin']) = '*' and lower(trim(headers['access-control-allow-credentials'])) = 'true'"
)
def cors(spark, d):
    return E.cors(documents(spark, d))


_LIBS = [Pattern(k, r, 1) for k, (r, _) in P.LIBRARIES.items()]
_OLD = "case name " + " ".join(f"when '{k}' then " + " or ".join(f"starts_with(value, '{p}')" for p in ps) for k, (_, ps) in P.LIBRARIES.items()) + " end"


@query(f"select file_id, url as file, name, value as version, {_OLD} as is_old, line from {D.hits('docs', _LIBS)} where match_ord = 1")
def dependencies(spark, d):
    return E.dependencies(documents(spark, d))


@query("select s_suppkey, 'lib' || s_nationkey as name, '1.' || s_suppkey as version, case when s_suppkey % 3 = 0 then ['CVE-2020-' || s_suppkey] else ['CVE-2021-1', 'CVE-2022-' || s_suppkey] end as cves from supplier where s_suppkey % 4 > 0")
def osv_flatten(spark, d):
    """Scanner reports made of suppliers, flattened."""
    one = "concat('{\"aliases\": [\"CVE-2020-', s_suppkey, '\", \"GHSA-1\"]}')"
    two = "concat('{\"aliases\": [\"CVE-2021-1\"]}, {\"aliases\": [\"CVE-2022-', s_suppkey, '\"]}, {}')"
    vulnerable = f"case when s_suppkey % 4 = 0 then '' when s_suppkey % 3 = 0 then {one} else {two} end"
    report = f"concat('{{\"results\": [{{\"packages\": [{{\"package\": {{\"name\": \"lib', s_nationkey, '\", \"version\": \"1.', s_suppkey, '\"}}, \"vulnerabilities\": [', {vulnerable}, ']}}]}}]}}')"
    return E.advisories(table(spark, d, "supplier").selectExpr("s_suppkey", f"{report} as payload"))


_TOKEN = Pattern("token", r"['\"]([A-Za-z0-9+/=_\-]{20,})['\"]", 1)
_ENT = "list_sum(list_transform(list_filter(list_sort(list_distinct(string_split(value, ''))), lambda c: c <> ''), lambda c: -((length(value) - length(replace(value, c, ''))) / length(value)) * log2((length(value) - length(replace(value, c, ''))) / length(value))))"


@query(
    f"""select file_id, url as source_url, line, e as entropy_score, substr(value, 1, 4) || repeat('*', length(value) - 8) || right(value, 4) as redacted_value, ph as partial_hash from (
  select *, row_number() over (partition by file_id order by match_ord) as k from (select *, row_number() over (partition by file_id, ph order by match_ord) as rn from (
    select *, {_ENT} as e, substr(sha256(value), 1, 12) as ph from {D.hits('docs', [_TOKEN])}) where e >= 4.0 and ph not in (select partial_hash from snapshot_secrets)) where rn = 1) where k <= 500"""
)
def entropy_tokens(spark, d):
    return E.entropy_tokens(documents(spark, d), table(spark, d, "snapshot_secrets"))


@query()
def top_entropy(spark, d):
    """The 30 tokens of highest entropy; ties by hash."""
    return R.top_by(entropy_tokens(spark, d).select("entropy_score", "redacted_value", "partial_hash").distinct(), [F.round("entropy_score", 9).desc(), F.col("partial_hash")], 30).select("partial_hash", "redacted_value")


ORACLES["top_entropy"] = f"select partial_hash, redacted_value from (select distinct round(entropy_score, 9) as e, redacted_value, partial_hash from ({ORACLES['entropy_tokens']})) order by e desc, partial_hash limit 30"


@query(f"select file_id, url from docs where regexp_matches(content, {D.lit(P.PLAINTEXT_KEYS)})")
def plaintext_leak_check(spark, d):
    docs = documents(spark, d)
    return docs.where(F.col("content").rlike(P.PLAINTEXT_KEYS)).select("file_id", "url")


# pages and URLs ---------------------------------------------------------------------------------------------------


@query()
def html_links(spark, d):
    return E.html_links(pages(spark, d))


@query()
def script_srcs(spark, d):
    return E.script_sources(pages(spark, d))


@query()
def third_party_scripts(spark, d):
    return E.third_party_scripts(pages(spark, d))


def _resolved(ref: str) -> str:
    """URL of a reference that is absolute, rooted, or relative with at most one leading dot-dot, as these pages have."""
    origin = "regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"
    folder = "regexp_extract(url, '^([A-Za-z]+://[^?#]*/)', 1)"
    return f"case when regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {ref} when starts_with({ref}, '/') then {origin} || {ref} when {ref} = '' then url when starts_with({ref}, '../') then regexp_replace({folder}, '[^/]*/$', '') || substr({ref}, 4) else {folder} || {ref} end"


_SAME = "regexp_extract({0}, '^([A-Za-z]+://[^/?#]*)', 1) = regexp_extract({1}, '^([A-Za-z]+://[^/?#]*)', 1)"
_PQ = "regexp_replace(regexp_replace({0}, '^[A-Za-z]+://[^/?#]*', ''), '#.*$', '')"
_REFS = f"""select file_id, url, 'html_link' as pattern_name, {D.lower_trim('value')} as ref from {D.hits('pages', [P.LINK])}
union all select file_id, url, case when lower(regexp_extract(text, {D.lit(P.FORM_METHOD)}, 1)) = 'post' then 'html_form_post' else 'html_form_get' end, {D.lower_trim(f"regexp_extract(text, {D.lit(P.FORM_ACTION)}, 1)")} from {D.hits('pages', [P.FORM])}"""
ORACLES["html_links"] = "with " + DOCS_SQL + f" select distinct file_id, url as source_url, pattern_name, {_PQ.format('target')} as value from (select *, {_resolved('ref')} as target from ({_REFS}) where not regexp_matches(ref, '^(javascript|mailto|tel):')) where {_SAME.format('target', 'url')} and {_PQ.format('target')} <> ''"
_SRCS = f"select distinct file_id, url as page_url, {_resolved('value')} as script_url from {D.hits('pages', [P.SCRIPT_SRC])}"
ORACLES["script_srcs"] = "with " + DOCS_SQL + " " + _SRCS
ORACLES["third_party_scripts"] = "with " + DOCS_SQL + f" select distinct {D.HOST.format('script_url')} as hostname, script_url, page_url from ({_SRCS}) where not ({_SAME.format('script_url', 'page_url')})"


@query()
def inline_scripts(spark, d):
    return E.inline_scripts(pages(spark, d))


ORACLES["inline_scripts"] = "with " + DOCS_SQL + f""" select file_id, 'inline:' || url || '#script-' || n as url, body as content from (
  select file_id, url, n, attrs, {D.lower_trim('raw')} as body, regexp_extract(attrs, {D.lit(P.SCRIPT_TYPE)}, 1) as kind from (
    select file_id, url, unnest(range(len(a))) as n, unnest(a) as attrs, unnest(b) as raw from (select file_id, url, {D.values(P.SCRIPT_ATTRIBUTES)} as a, {D.values(P.SCRIPT)} as b from pages)))
where not regexp_matches(attrs, {D.lit(P.SCRIPT_HAS_SRC)}) and (kind = '' or lower(kind) in {tuple(P.SCRIPT_TYPES)!r}) and length(body) >= {P.SHORTEST_SCRIPT}"""


@query()
def inline_script_endpoints(spark, d):
    """Endpoints, parameters and symbols reach inline scripts too; here the endpoints."""
    return E.endpoints(E.inline_scripts(pages(spark, d)))


ORACLES["inline_script_endpoints"] = f"select distinct file_id, url as source_url, name as pattern_name, value from {D.hits('(' + ORACLES['inline_scripts'] + ')', P.ENDPOINTS)} where value <> ''"


@query(f"select file_id, url, case when regexp_matches(ref, '^https?://') then ref else {_resolved('ref')} end as map_url from (select *, regexp_extract(content, {D.lit(P.SOURCE_MAP)}, 1) as ref from docs) where ref <> ''")
def source_map_refs(spark, d):
    return E.source_map_refs(documents(spark, d))


@query(
    """select file_id, url || ' (source map: ' || s || ')' as url, c as content from (select file_id, url, unnest(ss) as s, unnest(cs) as c from (
  select file_id, url, from_json(json_extract(content, '$.sources'), '["VARCHAR"]') as ss, from_json(json_extract(content, '$.sourcesContent'), '["VARCHAR"]') as cs
  from docs where contains(content, 'sourcesContent') and json_valid(content))) where s is not null and c is not null and c <> ''"""
)
def source_map_recovery(spark, d):
    return E.source_map_files(documents(spark, d))


_URLS = "(select distinct url from fetched_files union select distinct source_url from endpoints)"


def _urls(spark, d):
    e = table(spark, d, "endpoints").select(F.col("source_url").alias("url"))
    return table(spark, d, "fetched_files").select("url").unionByName(e).distinct()


_JS_SQL, _ASSET_SQL = (D.lit(r.replace("|$)", "|\\n?$)")) for r in (P.JS_URL, P.ASSET_URL))  # the end may stand before a last line feed


@query(f"select url, regexp_matches(url, {_JS_SQL}) as is_js, not regexp_matches(url, {_JS_SQL}) and not regexp_matches(url, {_ASSET_SQL}) as is_page from {_URLS}")
def url_kind(spark, d):
    return E.url_kinds(_urls(spark, d))


@query(f"select url, {_scope_sql('url')[0]} as allowed, {_scope_sql('url')[1]} as reason from {_URLS}")
def scope_decision(spark, d):
    return S.decisions(_urls(spark, d), SCOPE)


@query(f"select url, 'allowed' as side from {_URLS} where {_scope_sql('url')[0]} union all select url, 'denied' from {_URLS} where not {_scope_sql('url')[0]}")
def url_scope_split(spark, d):
    yes, no = S.collect([table(spark, d, "fetched_files").select("url"), table(spark, d, "endpoints").select(F.col("source_url").alias("url"))], SCOPE)
    return yes.withColumn("side", F.lit("allowed")).unionByName(no.withColumn("side", F.lit("denied")))


@query(f"select url, {D.HOST.format('url')} as host, {D.PATH.format('url')} as path from {_URLS}")
def url_parts(spark, d):
    return _urls(spark, d).select("url", X.hostname(F.col("url")).alias("host"), X.path(F.col("url")).alias("path"))


_ENV = f"case when contains({{0}}, '://') and regexp_matches({D.HOST}, {D.lit(P.ENV_DEV)}) then 'dev' when contains({{0}}, '://') and regexp_matches({D.HOST}, {D.lit(P.ENV_STAGING)}) then 'staging' when contains({{0}}, '://') and {D.HOST} <> '' then 'prod' else 'unknown' end"


def _fill(template: str, column: str) -> str:
    return template.replace("{0}", column)


@query(f"select url, {_fill(_ENV, 'url')} as environment from (select replace(url, '://app.', case when length(url) % 3 = 0 then '://dev.' when length(url) % 3 = 1 then '://staging.app.' else '://app.' end) as url from {_URLS})")
def endpoint_env(spark, d):
    n = F.length("url") % 3
    url = F.replace("url", F.lit("://app."), F.when(n == 0, "://dev.").when(n == 1, "://staging.app.").otherwise("://app."))
    return _urls(spark, d).select(url.alias("url")).select("url", R.environment(F.col("url")).alias("environment"))


_PATHV = "case when starts_with(value, '/') then value else '/' || ltrim(value, '/') end"


_PATH_OF = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(
    f"""select endpoint_id, value, source_url, case when source_url in (select unnest(auth_only_js_urls) from scan_runs) then 'auth-required'
  when {_PATHV} in (select {_PATH_OF} from fetched_files where origin = 'runtime' union select regexp_replace(value, '[?].*$', '') from snapshot_endpoints where tag = 'live') then 'live'
  when value in (select value from snapshot_endpoints where tag = 'historical') or not {_PATHV} in (select {_PATH_OF} from fetched_files union select regexp_replace(value, '[?].*$', '') from snapshot_endpoints where environment is not null) then 'historical' else 'live' end as tag,
  {_fill(_ENV, 'source_url')} as environment from endpoints"""
)
def endpoint_tags(spark, d):
    """Tags from auth-only scripts of the runs, paths seen at runtime, earlier snapshots and fetched URLs."""
    e = table(spark, d, "endpoints").select("endpoint_id", "value", "source_url")
    files, old = table(spark, d, "fetched_files").select("url", "origin"), table(spark, d, "snapshot_endpoints").select("value", "tag", "environment")
    path = lambda df: df.select(F.regexp_replace("value", "[?].*$", "").alias("path"))
    runtime = files.where("origin = 'runtime'").select(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path")).unionByName(path(old.where("tag = 'live'")))
    collected = files.select("url").unionByName(path(old.where("environment is not null")).select(F.concat(F.lit("https://x.example"), "path").alias("url")))
    auth = table(spark, d, "scan_runs").select(F.explode("auth_only_js_urls").alias("url"))
    return R.tag_endpoints(e, collected, old.where("tag = 'historical'").select("value"), auth, runtime).select("endpoint_id", "value", "source_url", "tag", "environment")


def _group_sql() -> str:
    out = "case " + " ".join("when " + " or ".join(f"contains(lower(value), '{w}')" for w in ws) + f" then '{g}'" for g, ws in P.API_GROUPS.items())
    return out + " when contains(lower(value), '/api/') then 'api' else 'general' end"


_MEMBERS = f"""select {_group_sql()} as group_name, value, regexp_matches(value, '/v(\\d+)/') and regexp_replace(value, '/v\\d+/', '/v' || cast(try_cast(regexp_extract(value, '/v(\\d+)/', 1) as bigint) + 1 as varchar) || '/', 'g') in (select value from endpoints) as is_old_version
from (select distinct value from endpoints where value is not null)"""


@query(_MEMBERS)
def api_group_members(spark, d):
    return R.api_group_members(table(spark, d, "endpoints"))


@query(f"select group_name, count(*) as endpoints, count(*) filter (is_old_version) as old_versions from ({_MEMBERS}) group by 1")
def api_groups(spark, d):
    return R.api_groups(table(spark, d, "endpoints"))


_IDENT = f"coalesce(nullif(regexp_extract({{0}}, {D.lit(P.PATH_IDENTIFIER)}, 1), ''), nullif(regexp_extract({{0}}, {D.lit(P.PATH_IDENTIFIER)}, 2), ''), nullif(regexp_extract({{0}}, {D.lit(P.QUERY_IDENTIFIER)}, 1), ''), case when regexp_matches({{0}}, {D.lit(P.NUMERIC_PATH)}) then 'id' end)"


@query(f"select endpoint_id, {_fill(_IDENT, 'value')} as identifier from endpoints")
def endpoint_identifier(spark, d):
    return table(spark, d, "endpoints").select("endpoint_id", R.endpoint_identifier(F.col("value")).alias("identifier"))


def _order(number, a=None, b=None):
    """A place that no two rows share by chance: a number, then the row's own texts."""
    return F.struct(number.cast("bigint").alias("n"), (a if a is not None else F.lit("")).alias("a"), (b if b is not None else F.lit("")).alias("b"))


def _object_inputs(spark, d):
    docs = documents(spark, d)
    eps = table(spark, d, "endpoints").select(_order(F.col("endpoint_id")).alias("ord"), "value", "source_url")
    more = E.endpoints(docs).select(_order(F.col("file_id") + F.lit(1 << 60), F.col("pattern_name"), F.col("value")).alias("ord"), "value", "source_url")
    params = E.parameters(docs).select(F.struct("file_id", "line", "name").alias("ord"), "name", "source_url", "function_name")
    return eps, more, params, docs


_PARAMS = f"({ORACLES['parameters']})"
_PROPS = f"""(select url, arg_max({{'p': ps, 's': spread}}, ord) as d from (select url, ord, list_filter(q, lambda x, i: list_position(q, x) = i)[1:10] as ps, spread from
  (select url, ord, {D.values(P.SENSITIVE_PROPERTY)} as q, {' or '.join(D.has(p) for p in P.SPREADS)} as spread from docs where content is not null)) group by 1)"""


def _objects_sql(endpoints: str, order: str) -> str:
    """All three kinds of candidates over (value, source_url, order)."""
    return f"""select o.endpoint, o.identifier, f.f.f as function_name, coalesce(d.d.p, []) as sensitive_properties,
  case when lower(o.identifier) in {tuple(P.CROSS_TENANT)!r} then 4 when len(coalesce(d.d.p, [])) > 0 then 3 when f.f.f is not null then 2 else 1 end as level, 'BOLA' as bug_class, o.source_url
from (select value as endpoint, {_fill(_IDENT, 'value')} as identifier, arg_min(source_url, {order}) as source_url from {endpoints} where {_fill(_IDENT, 'value')} is not null group by 1, 2) o
left join (select source_url, lower(name) as n, arg_min({{'f': function_name}}, (file_id, line, name)) as f from {_PARAMS} group by 1, 2) f on f.source_url = o.source_url and f.n = lower(o.identifier)
left join {_PROPS} d on d.url = o.source_url
union all select v.endpoint, 'privileged_path', g.f, []::varchar[], 2, 'BFLA', v.source_url from (select value as endpoint, arg_min(source_url, {order}) as source_url from {endpoints} where regexp_matches(value, {D.lit(P.PRIVILEGED)}) group by 1) v
left join (select source_url, arg_min(function_name, (file_id, line, name)) as f from {_PARAMS} where function_name is not null group by 1) g on g.source_url = v.source_url
union all select coalesce(e.endpoint, d.url), 'spread_pattern', null, d.d.p, 3, 'mass_assignment', d.url from {_PROPS} d
left join (select source_url, arg_min(value, {order}) as endpoint from {endpoints} group by 1) e on e.source_url = d.url where d.d.s and len(d.d.p) > 0"""


@query(_objects_sql("endpoints", "endpoint_id"))
def object_authorization(spark, d):
    """All three kinds of candidates of the endpoint table, with the functions and properties of the documents."""
    eps, _, params, docs = _object_inputs(spark, d)
    return R.object_access(eps, params, docs)


@query(_objects_sql("(select distinct file_id, url as source_url, name as pattern_name, value from " + D.hits("docs", P.ENDPOINTS) + " where value <> '')", "(file_id, pattern_name, value)"))
def object_authorization_docs(spark, d):
    """All three kinds of candidates from what the documents themselves call."""
    _, more, params, docs = _object_inputs(spark, d)
    return R.object_access(more, params, docs)


def _bundler_sql() -> str:
    s = {k: " + ".join(f"coalesce(regexp_matches(content, {D.lit(r)}), false)::int" for r in rx) for k, rx in P.BUNDLERS.items()}
    w, v, n = s["webpack"], s["vite"], s["next"]
    return f"case when greatest({w}, {v}, {n}) = 0 then 'unknown' when ({w}) >= ({v}) and ({w}) >= ({n}) then 'webpack' when ({v}) >= ({n}) then 'vite' else 'next' end"


@query(f"select file_id, {_bundler_sql()} as bundler from docs where content is not null")
def bundlers(spark, d):
    return documents(spark, d).where("content is not null").select("file_id", R.bundler(F.col("content")).alias("bundler"))


def _asset(spark, d):
    docs = documents(spark, d)
    return R.asset_nodes(docs, docs.where(F.col("content").startswith("{") & F.col("content").contains('"dynamicImports"')))


@query()
def asset_graph(spark, d):
    return _asset(spark, d)


@query()
def asset_edges(spark, d):
    return R.asset_edges(_asset(spark, d))


@query()
def asset_summary(spark, d):
    return R.asset_summary(_asset(spark, d), documents(spark, d))


def _graph(spark, d):
    e, s = table(spark, d, "endpoints"), table(spark, d, "snapshot_secrets")
    key = lambda *c: F.concat_ws(":", *[F.coalesce(x, F.lit("")) for x in c])
    return R.graph(
        table(spark, d, "fetched_files"),
        {"endpoint": (e, key("pattern_name", "value", "source_url"), "contains"), "secret": (s, key("secret_type", "partial_hash", "source_url"), "contains")},
    )


_FOUND = """(select distinct 'endpoint' as kind, 'endpoint:' || pattern_name || ':' || value || ':' || source_url as id, source_url from endpoints
union select distinct 'secret', 'secret:' || secret_type || ':' || partial_hash || ':' || source_url, source_url from snapshot_secrets)"""
_NODES = f"""select 'source:' || u as id, min(k) as kind from (select url as u, 'bundle' as k from fetched_files union select source_url, 'url' from {_FOUND}) group by 1 union all select distinct id, kind from {_FOUND}"""


@query(_NODES)
def graph_nodes(spark, d):
    return _graph(spark, d)[0]


@query(f"select 'source:' || source_url as source, id as target, 'contains' as relation from {_FOUND}")
def graph_edges(spark, d):
    return _graph(spark, d)[1]


@query(f"select count(*) as node_count, (select count(*) from {_FOUND}) as edge_count, count(*) filter (kind = 'bundle') as bundle_count from ({_NODES})")
def graph_stats(spark, d):
    return R.graph_stats(*_graph(spark, d))


def _full_graph(spark, d):
    """All five families of findings; a source whose body is here is a bundle."""
    e, s = table(spark, d, "endpoints"), table(spark, d, "snapshot_secrets")
    docs = documents(spark, d)
    key = lambda *c: F.concat_ws(":", *[F.coalesce(x, F.lit("")) for x in c])
    return R.graph(
        docs,
        {
            "endpoint": (e, key("pattern_name", "value", "source_url"), "contains"), "secret": (s, key("secret_type", "partial_hash", "source_url"), "contains"),
            "subdomain": (E.subdomains(docs, SCOPE.bases, S.decide(SCOPE)), key("domain", "source_url"), "references"),
            "parameter": (E.parameters(docs), key("name", "source_url"), "contains"), "dom_finding": (E.dom_findings(docs), key("sink_pattern", "source_url"), "contains"),
        },
    )


_ALL_FOUND = f"""(select *, 'contains' as relation from {_FOUND}
union select 'subdomain', 'subdomain:' || domain || ':' || source_url, source_url, 'references' from ({ORACLES['subdomains']})
union select 'parameter', 'parameter:' || name || ':' || source_url, source_url, 'contains' from ({ORACLES['parameters']})
union select 'dom_finding', 'dom_finding:' || sink_pattern || ':' || source_url, source_url, 'contains' from ({ORACLES['dom_findings']}))"""
_ALL_NODES = f"""select 'source:' || u as id, min(k) as kind from (select url as u, 'bundle' as k from docs union select source_url, 'url' from {_ALL_FOUND}) where u is not null group by 1 union all select distinct id, kind from {_ALL_FOUND}"""


@query(_ALL_NODES)
def graph_full_nodes(spark, d):
    return _full_graph(spark, d)[0]


@query(f"select 'source:' || source_url as source, id as target, relation from {_ALL_FOUND} where source_url is not null")
def graph_full_edges(spark, d):
    return _full_graph(spark, d)[1]


@query(f"select count(*) as node_count, (select count(*) from {_ALL_FOUND} where source_url is not null) as edge_count, count(*) filter (kind = 'bundle') as bundle_count from ({_ALL_NODES})")
def graph_full_stats(spark, d):
    return R.graph_stats(*_full_graph(spark, d))


@query(
    """select coalesce(a.value, b.value) as value, case when b.value is null then 'left_only' when a.value is null then 'right_only' else 'both' end as side
from (select distinct value from endpoints) a full join (select distinct value from snapshot_endpoints) b on a.value = b.value"""
)
def schema_discrepancy(spark, d):
    return R.set_comparison(table(spark, d, "endpoints"), table(spark, d, "snapshot_endpoints"))


@query(
    """select id, bs = ts as status_match, length(tb) - length(bb) as body_length_delta, list_sort(list_filter(tk, lambda k: not list_contains(bk, k))) as keys_added, list_sort(list_filter(bk, lambda k: not list_contains(tk, k))) as keys_removed,
  list_sort(list_filter(tk, lambda k: regexp_matches(lower(k), 'email|phone|ssn|address|token|password|name|dob|secret'))) as sensitive_fields,
  case when bs <> ts and ts in (401, 403, 404) then 'denied' when bs = ts and len(keys_added) = 0 and len(keys_removed) = 0 and len(sensitive_fields) > 0 then 'same_shape_sensitive' when bs = ts then 'same_status' else 'status_differs' end as suggestion
from (select a.event_id as id, 200 as bs, case a.event_id % 4 when 0 then 404 when 1 then 500 else 200 end as ts, a.props as bb, case when a.event_id % 3 = 0 then '{"name": 1, "k": 2}' else a.props end as tb,
  json_keys(a.props) as bk, json_keys(case when a.event_id % 3 = 0 then '{"name": 1, "k": 2}' else a.props end) as tk from events a)"""
)
def response_diff(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 4 == 0, 404).when(F.col("event_id") % 4 == 1, 500).otherwise(200)
    pairs = e.select(F.col("event_id").alias("id"), F.lit(200).alias("base_status"), F.col("props").alias("base_body"), status.alias("test_status"), F.when(F.col("event_id") % 3 == 0, '{"name": 1, "k": 2}').otherwise(F.col("props")).alias("test_body"))
    return R.response_diff(pairs)


@query()
def interest_score(spark, d):
    eps, more, params, docs = _object_inputs(spark, d)
    return R.interest_scores(
        {
            "secrets": table(spark, d, "snapshot_secrets"), "entropy": E.entropy_tokens(docs), "auth": E.auth_findings(docs), "dom": E.dom_taint(docs), "proto": E.proto_pollution(docs),
            "graphql": E.graphql_operations(docs), "parameters": E.parameters(docs), "object_access": R.object_access(eps.unionByName(more), params, docs),
        }
    )


@query("select endpoint_id, regexp_replace(regexp_replace(value, '/:[a-zA-Z_][a-zA-Z0-9_]*|\\{[a-zA-Z_][a-zA-Z0-9_]*\\}', '/REPLACE_ID', 'g'), '(/)\\d{3,}', '\\1REPLACE_ID', 'g') as template from endpoints")
def path_template(spark, d):
    return table(spark, d, "endpoints").select("endpoint_id", R.path_template(F.col("value")).alias("template"))


@query("select endpoint_id, case when regexp_matches(value, '\\d') then regexp_extract(value, '(?s)^(.*?)(\\d+)(\\D*)$', 1) || cast(cast(regexp_extract(value, '(?s)^(.*?)(\\d+)(\\D*)$', 2) as hugeint) + 1 as varchar) || regexp_extract(value, '(?s)^(.*?)(\\d+)(\\D*)$', 3) end as next_value from endpoints")
def increment_id(spark, d):
    return table(spark, d, "endpoints").select("endpoint_id", R.increment_last_number(F.col("value")).alias("next_value"))


@query(f"select url, case when ends_with(s, '.js') then s else s || '.js' end as slug from (select url, right(regexp_replace(url, '[^A-Za-z0-9_.\\-]', '_', 'g'), 120) as s from {_URLS})")
def url_slug(spark, d):
    return _urls(spark, d).select("url", R.url_slug(F.col("url")).alias("slug"))


@query(
    """select distinct v.value from (select distinct value, string_split(regexp_extract(case when starts_with(value, '/') then value else '/' || value end, '^([^?#]*)', 1), '/') as s from endpoints) v
join (select distinct string_split(regexp_replace(value, '\\{\\w+\\}', '4711', 'g'), '/') as r from snapshot_endpoints) p on len(v.s) = len(p.r)
where list_bool_and(list_transform(range(1, len(s) + 1), lambda i: s[i] = r[i] or regexp_matches(s[i], '^:\\w+$|^\\{\\w+\\}$') and r[i] <> ''))"""
)
def runtime_confirmed(spark, d):
    paths = table(spark, d, "snapshot_endpoints").select(F.regexp_replace("value", r"\{\w+\}", "4711").alias("path"))
    return R.template_matches(table(spark, d, "endpoints"), paths)


@query("select distinct scan_run_id from scan_results where scan_run_id is not null and scan_run_id not in (select scan_run_id from snapshot_secrets)")
def unresolved_citations(spark, d):
    return R.unresolved_citations(table(spark, d, "scan_results").where("scan_run_id is not null"), table(spark, d, "snapshot_secrets"), "scan_run_id")


@query("select endpoint_id, cast(floor((row_number() over (order by endpoint_id) - 1) / 20) as bigint) as batch from endpoints")
def batch_ids(spark, d):
    return R.batches(table(spark, d, "endpoints").select("endpoint_id"), "endpoint_id", 20)


_INJ = " or ".join(f"regexp_matches({{0}}, {D.lit('(?i)' + r)})" for r in P.INJECTIONS)


@query(f"select distinct substr(sha256(coalesce(pattern_name, '') || ':' || coalesce(value, '') || ':' || coalesce(source_url, '')), 1, 16) as evidence_id, pattern_name, value, source_url, coalesce({_fill(_INJ, 'value')}, false) or coalesce({_fill(_INJ, 'source_url')}, false) as injection_suspected from endpoints")
def evidence_items(spark, d):
    return R.evidence_items(table(spark, d, "endpoints"))


_TEXTS = "(select doc_id as id, text from documents union all select file_id, content from docs)"


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(documents(spark, d).select(F.col("file_id").alias("id"), F.col("content").alias("text")))


@query(f"select id from {_TEXTS} where {_fill(_INJ, 'text')}")
def injection_flags(spark, d):
    odd = F.lit(False)
    for r in P.INJECTIONS:
        odd = odd | F.col("text").rlike("(?i)" + r)
    return _texts(spark, d).where(odd).select("id")


@query(f"select id from {_TEXTS} where " + " or ".join(f"contains(lower(text), '{w}')" for w in P.UNSAFE_WORDS))
def unsafe_text(spark, d):
    return R.unsafe_texts(_texts(spark, d), "text").select("id")


@query("select pattern_name, value, source_url, arg_max(tag, endpoint_id) as tag, max(endpoint_id) as endpoint_id, min(endpoint_id) as first_order from endpoints group by 1, 2, 3")
def normalize_endpoints(spark, d):
    rows = table(spark, d, "endpoints").select("pattern_name", "value", "source_url", "tag", "endpoint_id")
    return R.normalized(rows, ["pattern_name", "value", "source_url"], "endpoint_id")


@query("select distinct secret_type, partial_hash, source_url, severity from snapshot_secrets qualify row_number() over (partition by secret_type, partial_hash, source_url order by severity desc, redacted_value desc) = 1")
def normalize_secrets(spark, d):
    rows = table(spark, d, "snapshot_secrets").select("secret_type", "partial_hash", "source_url", "severity", "redacted_value")
    best = rows.groupBy("secret_type", "partial_hash", "source_url").agg(F.max(F.struct("severity", "redacted_value")).alias("b"))
    return best.select("secret_type", "partial_hash", "source_url", "b.severity")


_LAST = "(select arg_max(scan_run_id, (started_at, scan_run_id)) as scan_run_id from scan_runs group by target)"


@query(f"select distinct scan_run_id, value, source_url from snapshot_endpoints where scan_run_id in {_LAST}")
def latest_snapshot(spark, d):
    """Endpoints of the last run of every target."""
    last = table(spark, d, "scan_runs").groupBy("target").agg(F.max_by("scan_run_id", F.struct("started_at", "scan_run_id")).alias("scan_run_id")).select("scan_run_id")
    return table(spark, d, "snapshot_endpoints").join(last, "scan_run_id", "left_semi").select("scan_run_id", "value", "source_url").distinct()


@query("select distinct u as url from (select unnest(auth_only_js_urls) as u from scan_runs) where u not in (select url from fetched_files)")
def auth_only_scripts(spark, d):
    urls = table(spark, d, "scan_runs").select(F.explode("auth_only_js_urls").alias("url")).distinct()
    return urls.join(table(spark, d, "fetched_files").select("url").distinct(), "url", "left_anti")


@query("select distinct url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from fetched_files where origin = 'runtime' and url not in (select url from fetched_files where origin = 'fetch')")
def runtime_js(spark, d):
    f = table(spark, d, "fetched_files").select("url", "origin")
    new = f.where("origin = 'runtime'").select("url").distinct().join(f.where("origin = 'fetch'").select("url").distinct(), "url", "left_anti")
    return new.select("url", F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"))


@query(
    "select 'endpoints' as family, count(*) as items from endpoints union all select 'secrets', count(*) from snapshot_secrets union all select 'files', count(*) from fetched_files union all select 'runs', count(distinct scan_run_id) from scan_runs"
)
def summary(spark, d):
    one = lambda n, df, c: df.agg(c.cast("bigint").alias("items")).select(F.lit(n).alias("family"), "items")
    rows = F.count(F.lit(1))
    out = one("endpoints", table(spark, d, "endpoints"), rows).unionByName(one("secrets", table(spark, d, "snapshot_secrets"), rows))
    return out.unionByName(one("files", table(spark, d, "fetched_files"), rows)).unionByName(one("runs", table(spark, d, "scan_runs"), F.count_distinct("scan_run_id")))


@query("select distinct value from endpoints where value is not null")
def wordlist_endpoints(spark, d):
    return table(spark, d, "endpoints").where("value is not null").select("value").distinct()


_EVERY = """(select endpoint_id as n, '' as a, '' as b, value, source_url from endpoints union all select distinct file_id + 1152921504606846976, pattern_name, value, value, source_url from (""" + ORACLES["endpoints_docs"] + "))"
_TEMPLATE = "regexp_replace(regexp_replace({0}, '/:[a-zA-Z_][a-zA-Z0-9_]*|\\{[a-zA-Z_][a-zA-Z0-9_]*\\}', '/REPLACE_ID', 'g'), '(/)\\d{3,}', '\\1REPLACE_ID', 'g')"


@query(
    f""", cand as ({_objects_sql(_EVERY, '(n, a, b)')})
select distinct '1 object access' as section, {_TEMPLATE.replace('{0}', 'endpoint')} as item from cand where bug_class = 'BOLA' union all select distinct '2 privileged', endpoint from cand where bug_class = 'BFLA'
union all (select '3 auth-required', item from (select {_TEMPLATE.replace('{0}', 'value')} as item, min(value) as o from endpoints where tag = 'auth-required' group by 1) order by o, item limit 30)
union all (select '4 graphql', endpoint from (select distinct endpoint from ({ORACLES['graphql_ops']})) order by endpoint nulls first limit 5)
union all (select '5 others', item from (select {_TEMPLATE.replace('{0}', 'value')} as item, min(value) as o from endpoints where tag in ('live', 'historical') and value not in (select endpoint from cand where endpoint is not null)
  and value not in (select value from endpoints where tag = 'auth-required' and value is not null) group by 1) order by o, item limit 50)"""
)
def review_queue(spark, d):
    eps, more, params, docs = _object_inputs(spark, d)
    return R.review_queue(R.object_access(eps.unionByName(more), params, docs), table(spark, d, "endpoints"), E.graphql_operations(docs))


@query("select tag, severity, n from (select 'x' as tag, severity, count(*) as n from snapshot_secrets group by 2) order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 99 end")
def severity_order(spark, d):
    rows = table(spark, d, "snapshot_secrets").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(R.severity_rank(F.col("severity"))).select(F.lit("x").alias("tag"), "severity", "n")
