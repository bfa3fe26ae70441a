"""Table functions: a table of documents (file_id, url, content, headers) in, rows of findings out.

Each is one narrow scan with patterns as literals (compiled once) behind a cheap existence test, then an explode.
First-wins rules inside a document are ``first_wins``: a map-side combined aggregation over findings, never over
contents, so a hot source shuffles only its findings. Null contents give no rows; texts may be of any length.
Order inside a document is (pattern, match); rows carry file_id, so equal documents stay apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import patterns as P
from lintlake.functions import text as X
from lintlake.functions.text import Pattern


def scan(docs: DataFrame, patterns: list[Pattern], keep: list[str] | None = None) -> DataFrame:
    """(kept columns, pat_ord, name, match_ord, line, text, value) for every match of every pattern."""
    kept = keep or ["file_id", "url"]
    any_of = reduce(lambda a, b: a | b, [F.col("content").rlike(p.java) for p in patterns])
    rows = docs.where(F.col("content").isNotNull() & any_of).select(*kept, F.explode(X.hits("content", patterns)).alias("h"))
    return rows.select(*kept, "h.*")


def first_wins(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("pat_ord", "match_ord")) -> DataFrame:
    """The first row of each key in the order of extraction."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias("_b"))
    return best.select(*keys, "_b.*").select(*rows.columns)


def _flag_any(patterns: list[Pattern]) -> Column:
    return reduce(lambda a, b: a | b, [X.has("content", p) for p in patterns])


def endpoints(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, pattern_name, value), one row per pattern and value of a document."""
    rows = scan(docs, P.ENDPOINTS).where("value <> ''")
    return rows.select("file_id", F.col("url").alias("source_url"), F.col("name").alias("pattern_name"), "value").distinct()


def frameworks(docs: DataFrame) -> DataFrame:
    """(file_id, url, frameworks): sorted names, empty where none is found."""
    found = F.array_compact(F.array(*[F.when(X.has("content", p), F.lit(p.name)) for p in P.FRAMEWORKS]))
    return docs.select("file_id", "url", F.array_sort(found).alias("frameworks"))


def parameters(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, name, function_name, line): security-worded names, declared ones before query keys.

    The function is the nearest one named at or above the line, at most 50 lines up; in a line the first counts.
    """
    words = F.array(*[F.lit(w) for w in P.PARAMETER_WORDS])
    rows = scan(docs, [P.DECLARED, P.QUERIED], ["file_id", "url", "content"]).where(F.arrays_overlap(X.words(F.col("value")), words))
    above = F.reverse(F.slice(F.split("content", "\n", -1), F.greatest(F.lit(1), F.col("line") - P.FUNCTION_REACH), F.least(F.col("line"), F.lit(P.FUNCTION_REACH + 1))))
    rx = f"(?dU){P.FUNCTION_NAME}"
    line = F.get(F.filter(above, lambda x: x.rlike(rx)), 0)
    name = F.coalesce(F.nullif(F.regexp_extract(line, rx, 1), F.lit("")), F.nullif(F.regexp_extract(line, rx, 2), F.lit("")))
    named = rows.select("file_id", F.col("url").alias("source_url"), F.col("value").alias("name"), "pat_ord", "match_ord", "line", name.alias("function_name"))
    return first_wins(named, ["file_id", "source_url", "name"]).select("file_id", "source_url", "name", "function_name", "line")


def subdomains(docs: DataFrame, bases: list[str], decide) -> DataFrame:
    """(file_id, source_url, domain, in_scope, note): hosts under the base domains, lower case.

    Host-like tokens are cut out in one linear pass and shortened to what can precede a base domain, so that a long
    run of labels costs neither stack nor quadratic time. ``decide`` gives a host's (allowed, reason) columns.
    """
    if not bases:
        return docs.sparkSession.createDataFrame([], "file_id bigint, source_url string, domain string, in_scope boolean, note string")
    parts = []
    for base in sorted(bases):
        plain = base.lower().replace(".", r"\.")
        tokens = F.filter(F.regexp_extract_all("content", F.lit(r"(?i)[a-z0-9.-]++"), F.lit(0)), lambda t: F.lower(t).contains(f".{base.lower()}"))
        rx = rf"(?i)(?:{P.LABEL}\.)+{plain}\b"
        near = F.transform(tokens, lambda t: F.regexp_replace(t, rf"(?i)^.*?(.{{0,300}}\.{plain})", "$1"))
        hosts = F.flatten(F.transform(near, lambda t: F.regexp_extract_all(t, F.lit(rx), F.lit(0))))
        parts.append(F.transform(hosts, F.lower))
    found = docs.where(F.lower("content").contains(".")).select("file_id", F.col("url").alias("source_url"), F.explode(F.array_distinct(F.concat(*parts))).alias("domain"))
    allowed, reason = decide(F.col("domain"))
    note = F.concat(F.when(allowed, F.lit("in scope: ")).otherwise("discovered, flagged for manual review: "), reason)
    return found.select("file_id", "source_url", "domain", allowed.alias("in_scope"), note.alias("note"))


def symbols(docs: DataFrame) -> DataFrame:
    """(file_id, file, name, kind, line): the first declaration of each name; an export list names all its words."""
    rows = scan(docs, P.SYMBOLS)
    listed = F.col("text").startswith("export") & F.col("text").contains("{")
    names = F.when(listed, F.regexp_extract_all("value", F.lit(P.NAME), F.lit(0))).otherwise(F.array("value"))
    each = rows.select("file_id", "url", "pat_ord", "match_ord", "line", F.col("name").alias("kind"), F.posexplode(names).alias("part", "name"))
    best = first_wins(each, ["file_id", "url", "name"], ("pat_ord", "match_ord", "part"))
    return best.select("file_id", F.col("url").alias("file"), "name", "kind", "line")


def comments(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, text, line, keyword_matched): comment lines with a word of interest, one row per word."""
    rows = scan(docs, [P.LINE_COMMENT, P.BLOCK_COMMENT])
    lines = F.when(F.col("name") == "block", F.split("value", "\n", -1)).otherwise(F.array("value"))
    each = rows.select("file_id", "url", "pat_ord", "match_ord", "line", F.posexplode(lines).alias("part", "comment"))
    low = F.lower("comment")
    hit = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in sorted(P.COMMENT_WORDS)]))
    each = each.select("file_id", "url", "pat_ord", "match_ord", "part", (F.col("line") + F.col("part")).alias("line"), F.trim(F.regexp_replace("comment", r"^\s+|\s+$", "")).alias("clean"), F.explode(hit).alias("keyword_matched"))
    each = each.withColumn("short", F.substring("clean", 1, 120))
    best = first_wins(each, ["file_id", "url", "short", "keyword_matched"], ("pat_ord", "match_ord", "part"))
    return best.select("file_id", F.col("url").alias("source_url"), F.substring("clean", 1, 200).alias("text"), "line", "keyword_matched")


def feature_flags(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, key, value_hint, line): the key and value are sought in 120 characters from the match."""
    rows = scan(docs, P.FLAGS, ["file_id", "url", "content"])
    start = _offset(F.col("content"), F.element_at(F.array(*[F.lit(p.java) for p in P.FLAGS]), F.col("pat_ord") + 1), F.col("match_ord"))
    snippet = F.substr("content", start, F.lit(P.FLAG_SNIPPET))
    key = F.regexp_extract(snippet, f"(?dU){P.FLAG_KEY}", 1)
    value = F.regexp_extract(F.substr(snippet, F.length("text") + 1), f"(?dU){P.FLAG_VALUE}", 0)
    each = rows.select("file_id", "url", "pat_ord", "match_ord", "line", F.when(key != "", key).otherwise(F.substring("text", 1, 40)).alias("key"), value.alias("value_hint"))
    best = first_wins(each, ["file_id", "url", "key", "line"])
    return best.select("file_id", F.col("url").alias("source_url"), "key", "value_hint", "line")


def _offset(content: Column, rx: Column, nth: Column) -> Column:
    """Position (from 1) of the nth match."""
    gaps, found = F.split(content, rx, -1), F.regexp_extract_all(content, rx, F.lit(0))
    return F.length(F.concat(F.array_join(F.slice(gaps, 1, nth), ""), F.array_join(F.slice(found, 1, nth - 1), ""))) + 1


def graphql_operations(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, op_type, op_name, endpoint, variables, fields, line, is_persisted, persisted_hash).

    Templates first, then operations anywhere with 500 characters of body, then persisted hashes; one row per type
    and name of a document.
    """
    endpoint = F.coalesce(
        F.nullif(F.regexp_extract("content", P.GQL_ENDPOINT, 1), F.lit("")), F.nullif(F.regexp_extract("content", P.GQL_ENDPOINT_FETCH, 1), F.lit("")), F.lit("/graphql")
    )
    keep = ["file_id", "url", "endpoint", "content"]
    base = docs.where(_flag_any([P.GQL_TEMPLATE, P.GQL_OPERATION, P.GQL_PERSISTED])).withColumn("endpoint", endpoint)
    templates = scan(base, [P.GQL_TEMPLATE], keep)
    inner = F.regexp_extract_all("value", F.lit(P.GQL_OPERATION.java), F.lit(0))
    pairs = F.transform(inner, lambda t: F.struct(F.lower(F.regexp_extract(t, r"^(\w+)", 1)).alias("op_type"), F.regexp_extract(t, P.GQL_OPERATION.java, 1).alias("op_name")))
    unnamed = F.when(F.trim("value") != "", F.array(F.struct(F.lit("unknown").alias("op_type"), F.concat(F.lit("anonymous_"), F.col("line")).alias("op_name"))))
    named = templates.select(
        "file_id", "url", "endpoint", F.lit(0).alias("pass"), "match_ord", "line", F.col("value").alias("body"),
        F.posexplode(F.when(F.size(inner) > 0, pairs).otherwise(unnamed)).alias("part", "op"),
    ).select("file_id", "url", "endpoint", "pass", "match_ord", "part", "line", "body", "op.op_type", "op.op_name", F.lit("").alias("persisted_hash"))
    anywhere = scan(base, [P.GQL_OPERATION], keep)
    start = _offset(F.col("content"), F.lit(P.GQL_OPERATION.java), F.col("match_ord"))
    inline = anywhere.select(
        "file_id", "url", "endpoint", F.lit(1).alias("pass"), "match_ord", F.lit(0).alias("part"), "line", F.substr("content", start, F.lit(500)).alias("body"),
        F.lower(F.regexp_extract("text", r"^(\w+)", 1)).alias("op_type"), F.col("value").alias("op_name"), F.lit("").alias("persisted_hash"),
    )
    stored = scan(base, [P.GQL_PERSISTED], keep).select(
        "file_id", "url", "endpoint", F.lit(2).alias("pass"), "match_ord", F.lit(0).alias("part"), "line", F.lit("").alias("body"),
        F.lit("persisted").alias("op_type"), F.concat(F.lit("persisted_"), F.substring("value", 1, 16)).alias("op_name"), F.col("value").alias("persisted_hash"),
    )
    best = first_wins(named.unionByName(inline).unionByName(stored), ["file_id", "url", "op_type", "op_name"], ("pass", "match_ord", "part"))
    return best.select(
        "file_id", F.col("url").alias("source_url"), "op_type", "op_name", "endpoint",
        F.array_distinct(F.regexp_extract_all("body", F.lit(P.GQL_VARIABLE), F.lit(1))).alias("variables"),
        F.array_distinct(F.regexp_extract_all("body", F.lit(P.GQL_FIELD), F.lit(1))).alias("fields"),
        "line", (F.col("persisted_hash") != "").alias("is_persisted"), "persisted_hash",
    )


def graphql_clients(docs: DataFrame) -> DataFrame:
    """(file_id, url) of documents with a GraphQL client library."""
    return docs.where(_flag_any(P.GQL_CLIENTS)).select("file_id", "url")


def graphql_risk(operations: DataFrame) -> DataFrame:
    """(file_id, op_type, op_name, risk, detail): sensitive mutations, owner ids as variables, sensitive fields."""
    low = F.lower("op_name")
    sensitive = (F.col("op_type") == "mutation") & reduce(lambda a, b: a | b, [low.contains(w) for w in P.GQL_SENSITIVE_OPERATIONS])
    owners = F.filter("variables", lambda v: F.regexp_replace(F.lower(v), "s+$", "").isin(P.GQL_OWNER_IDS))
    fields = F.filter("fields", lambda f: F.lower(f).isin(P.GQL_SENSITIVE_FIELDS))
    risks = F.array_compact(F.array(
        F.when(sensitive, F.struct(F.lit("sensitive_mutation").alias("risk"), F.col("op_name").alias("detail"))),
        F.when(F.size(owners) > 0, F.struct(F.lit("owner_ids").alias("risk"), F.array_join(owners, ",").alias("detail"))),
        F.when(F.size(fields) > 0, F.struct(F.lit("sensitive_fields").alias("risk"), F.array_join(fields, ",").alias("detail"))),
    ))
    return operations.select("file_id", "op_type", "op_name", F.explode(risks).alias("r")).select("file_id", "op_type", "op_name", "r.risk", "r.detail")


def websockets(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, endpoint, protocol, auth_in_url, message_actions, object_ids, has_origin_check, line)."""
    actions = F.slice(F.array_distinct(F.concat(*[F.array_distinct(X.all_values("content", p)) for p in P.WS_ACTIONS])), 1, P.WS_MOST_ACTIONS)
    base = docs.where(_flag_any(P.WEBSOCKETS)).withColumns({
        "message_actions": actions, "object_ids": F.array_distinct(X.all_values("content", P.WS_OBJECT_ID)), "has_origin_check": X.has("content", P.WS_ORIGIN), "named_io": X.has("content", P.WEBSOCKETS[3]),
    })
    keep = ["file_id", "url", "message_actions", "object_ids", "has_origin_check", "named_io"]
    rows = scan(base, P.WEBSOCKETS, keep).where("not (name = 'socketio_default' and named_io)")
    once = ["socketio_default", "stomp", "graphql-ws"]
    rows = rows.where(~F.col("name").isin(once) | (F.col("match_ord") == 1))
    fixed = {"socketio_default": "/socket.io", "stomp": "/stomp", "graphql-ws": "/graphql"}
    endpoint = F.when(F.col("name") == "dynamic", F.concat(F.lit("dynamic:"), F.substring(F.regexp_replace("value", r"^\s+|\s+$", ""), 1, 60))).otherwise(F.col("value"))
    for k, v in fixed.items():
        endpoint = F.when(F.col("name") == k, F.lit(v)).otherwise(endpoint)
    protocol = F.when(F.col("name") == "dynamic", "websocket").when(F.col("name") == "socketio_default", "socketio").otherwise(F.col("name"))
    each = rows.select(*keep[:5], "pat_ord", "match_ord", "line", endpoint.alias("endpoint"), protocol.alias("protocol"))
    best = first_wins(each, ["file_id", "url", "endpoint", "protocol"])
    return best.select(
        "file_id", F.col("url").alias("source_url"), "endpoint", "protocol", F.col("endpoint").rlike(P.WS_AUTH).alias("auth_in_url"), "message_actions", "object_ids", "has_origin_check", "line"
    )


def websocket_risk(findings: DataFrame) -> DataFrame:
    """(file_id, endpoint, protocol, risk): token in the URL, object ids without origin check, no origin check."""
    open_ = ~F.col("has_origin_check")
    risks = F.array_compact(F.array(
        F.when(F.col("auth_in_url"), F.lit("token_in_url")),
        F.when((F.size("object_ids") > 0) & open_, F.lit("object_ids_unchecked")),
        F.when(open_ & F.col("protocol").isin("websocket", "socketio"), F.lit("no_origin_check")),
    ))
    return findings.select("file_id", "endpoint", "protocol", F.explode(risks).alias("risk"))


def auth_findings(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, finding_type, detail, severity_candidate, line), one row per type and line.

    Absence findings (no state, no PKCE) stand at line 1 of documents that show OAuth activity.
    """
    rows = scan(docs, P.AUTH).where(~F.col("name").isin(P.AUTH_FIRST_ONLY) | (F.col("match_ord") == 1))
    present = rows.select("file_id", "url", "pat_ord", "match_ord", "line", F.col("name").alias("finding_type"), F.substring(F.when(F.col("name").startswith("token_in_") & ~F.col("name").endswith("url"), F.col("value")).otherwise(F.col("text")), 1, 80).alias("detail"))
    oauth = X.has("content", P.OAUTH_ENDPOINT) | X.has("content", P.AUTH[9])
    missing = F.array_compact(F.array(
        F.when(oauth & ~X.has("content", P.STATE), F.lit("oauth_missing_state")), F.when(oauth & ~X.has("content", P.PKCE), F.lit("oauth_missing_pkce"))
    ))
    absent = docs.where(F.col("content").isNotNull()).select("file_id", "url", F.lit(99).alias("pat_ord"), F.lit(1).alias("match_ord"), F.lit(1).alias("line"), F.explode(missing).alias("finding_type"), F.lit("").alias("detail"))
    best = first_wins(present.unionByName(absent), ["file_id", "url", "finding_type", "line"])
    severity = F.lit(None).cast("string")
    for k, v in P.AUTH_SEVERITY.items():
        severity = F.when(F.col("finding_type") == k, v).otherwise(severity)
    refresh = (F.col("finding_type") == "token_in_localstorage") & F.lower("detail").contains("refresh")
    return best.select("file_id", F.col("url").alias("source_url"), "finding_type", "detail", F.when(refresh, "high").otherwise(severity).alias("severity_candidate"), "line")


def dom_findings(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, sink_pattern, sink_value, co_occurring_sources): sinks of documents that have a source."""
    sources = F.array_sort(F.array_compact(F.array(*[F.when(X.has("content", p), F.lit(p.name)) for p in P.DOM_SOURCES])))
    sinks = F.array_compact(F.array(*[
        F.when(X.has("content", p), F.struct(F.lit(p.name).alias("sink_pattern"), F.regexp_extract("content", p.java, 0).alias("sink_value"))) for p in P.DOM_SINKS
    ]))
    rows = docs.where(_flag_any(P.DOM_SOURCES)).select("file_id", F.col("url").alias("source_url"), sources.alias("co_occurring_sources"), F.explode(sinks).alias("s"))
    return rows.select("file_id", "source_url", "s.sink_pattern", "s.sink_value", "co_occurring_sources")


def dom_taint(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, source_name, source_line, sink_name, sink_line, sink_category, variable_bridge).

    A nearest-neighbour band join inside the document: every sink takes the nearest source at most 35 lines away,
    of equally near ones the first in (pattern, position) order. Both sides are arrays of the row, so nothing moves.
    """
    base = docs.where(_flag_any(P.TAINT_SOURCES) & _flag_any(P.TAINT_SINKS)).select("file_id", "url", "content", X.hits("content", P.TAINT_SOURCES).alias("sources"), X.hits("content", P.TAINT_SINKS).alias("sinks"))
    rows = base.select("file_id", "url", "content", "sources", F.explode("sinks").alias("k"))
    near = F.filter("sources", lambda s: F.abs(s["line"] - F.col("k.line")) <= P.TAINT_REACH)
    ranked = F.transform(near, lambda s: F.struct(F.abs(s["line"] - F.col("k.line")).alias("d"), s["pat_ord"].alias("p"), s["match_ord"].alias("m"), s["line"].alias("line"), s["name"].alias("name")))
    rows = rows.withColumn("best", F.array_min(ranked)).where("best is not null")
    lo, hi = F.least("best.line", "k.line"), F.greatest("best.line", "k.line")
    between = F.array_join(F.slice(F.split("content", "\n", -1), lo, hi - lo + 1), "\n")
    category = F.lit(None).cast("string")
    for name, kind in P.TAINT_CATEGORY.items():
        category = F.when(F.col("k.name") == name, kind).otherwise(category)
    return rows.select(
        "file_id", F.col("url").alias("source_url"), F.col("best.name").alias("source_name"), F.col("best.line").alias("source_line"), F.col("k.name").alias("sink_name"),
        F.col("k.line").alias("sink_line"), category.alias("sink_category"), F.nullif(F.regexp_extract(between, P.ASSIGNED.java, 1), F.lit("")).alias("variable_bridge"),
    ).distinct()


def taint_risk(findings: DataFrame) -> DataFrame:
    """(source_url, xss, code_exec, open_redirect, message_data, sources): counts and sorted sources per document."""
    count = lambda c: F.count_if(c).alias
    return findings.groupBy("source_url").agg(
        count(F.col("sink_category") == "xss")("xss"), count(F.col("sink_category") == "code_exec")("code_exec"), count(F.col("sink_category") == "open_redirect")("open_redirect"),
        count(F.col("source_name") == "event.data")("message_data"), F.array_sort(F.collect_set("source_name")).alias("sources"),
    )


def proto_pollution(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, level, pattern_name, detail, gadgets, line), one row per pattern and line."""
    gadgets = F.array_compact(F.array(*[F.when(X.has("content", p), F.lit(p.name)) for p in P.GADGETS]))
    base = docs.where(F.col("content").isNotNull()).withColumn("gadgets", gadgets)
    rows = scan(base, [p for _, p in P.PROTO], ["file_id", "url", "gadgets"])
    best = first_wins(rows, ["file_id", "url", "name", "line"])
    level = F.element_at(F.array(*[F.lit(n) for n, _ in P.PROTO]), F.col("pat_ord") + 1)
    return best.select("file_id", F.col("url").alias("source_url"), level.alias("level"), F.col("name").alias("pattern_name"), F.substring("text", 1, 100).alias("detail"), "gadgets", "line")


def proto_risk(findings: DataFrame) -> DataFrame:
    """(source_url, max_level, writes, merges, dynamic_writes, gadgets) per document."""
    return findings.groupBy("source_url").agg(
        F.max("level").alias("max_level"), F.count_if(F.col("level") == 5).alias("writes"), F.count_if(F.col("level") == 3).alias("merges"), F.count_if(F.col("level") == 4).alias("dynamic_writes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("gadgets")))).alias("gadgets"),
    )


def postmessage(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, kind, target_origin, has_origin_check, data_sinks, line), one row per kind and line.

    A receiver's origin check and sinks are sought in the 25 lines around it.
    """
    rows = scan(docs, [P.POST_SEND, P.POST_LISTEN], ["file_id", "url", "content"])
    around = X.context(F.col("content"), F.col("line"), P.POST_REACH)
    each = rows.select("file_id", "url", "pat_ord", "match_ord", "line", F.col("name").alias("kind"), "value", F.when(F.col("name") == "receiver", around).alias("around"))
    best = first_wins(each, ["file_id", "url", "kind", "line"])
    sinks = F.array_compact(F.array(*[F.when(F.coalesce(F.col("around").rlike(p.java), F.lit(False)), F.lit(p.name)) for p in P.POST_SINKS]))
    origin = F.nullif(F.regexp_replace("value", "^['\"` ]+|['\"` ]+$", ""), F.lit(""))
    return best.select(
        "file_id", F.col("url").alias("source_url"), "kind", F.when(F.col("kind") == "sender", origin).alias("target_origin"),
        F.coalesce(F.col("around").rlike(P.POST_ORIGIN.java), F.lit(False)).alias("has_origin_check"), sinks.alias("data_sinks"), "line",
    )


def postmessage_risk(findings: DataFrame) -> DataFrame:
    """(source_url, wildcard_senders, unchecked_receivers, sinks) per document."""
    return findings.groupBy("source_url").agg(
        F.count_if((F.col("kind") == "sender") & (F.col("target_origin") == "*")).alias("wildcard_senders"),
        F.count_if((F.col("kind") == "receiver") & ~F.col("has_origin_check")).alias("unchecked_receivers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("data_sinks")))).alias("sinks"),
    )


def workers(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, worker_type, worker_url, has_fetch_intercept, has_importscripts, importscripts_urls,
    is_inline_blob, has_skip_waiting, has_clients_claim, line), one row per type and URL; a dynamic one per document."""
    urls = F.flatten(F.transform(X.all_values("content", P.IMPORT_SCRIPTS), lambda c: F.regexp_extract_all(c, F.lit(P.QUOTED_URL), F.lit(1))))
    base = docs.where(_flag_any(P.WORKERS)).withColumns({"importscripts_urls": urls, "fetches": X.has("content", P.WORKER_FETCH), "skips": X.has("content", P.WORKER_SKIP), "claims": X.has("content", P.WORKER_CLAIM)})
    rows = scan(base, P.WORKERS, ["file_id", "url", "importscripts_urls", "fetches", "skips", "claims"])
    literal = F.col("name").isin("service_worker", "web_worker", "shared_worker")
    each = rows.withColumn("key", F.when(literal, F.col("value")).otherwise(F.lit("__none__")))
    best = first_wins(each, ["file_id", "url", "name", "key"])
    kind = F.when(F.col("name") == "service_worker_dynamic", "service_worker").when(F.col("name") == "blob_worker", "web_worker").otherwise(F.col("name"))
    service = kind == "service_worker"
    return best.select(
        "file_id", F.col("url").alias("source_url"), kind.alias("worker_type"), F.when(literal, F.col("value")).alias("worker_url"), (service & F.col("fetches")).alias("has_fetch_intercept"),
        (F.size("importscripts_urls") > 0).alias("has_importscripts"), "importscripts_urls", (F.col("name") == "blob_worker").alias("is_inline_blob"),
        (service & F.col("skips")).alias("has_skip_waiting"), (service & F.col("claims")).alias("has_clients_claim"), "line",
    )


def worker_risk(findings: DataFrame) -> DataFrame:
    """(source_url, intercepting, skip_waiting, blobs, external_imports) per document."""
    return findings.groupBy("source_url").agg(
        F.count_if("has_fetch_intercept").alias("intercepting"), F.count_if((F.col("worker_type") == "service_worker") & F.col("has_skip_waiting")).alias("skip_waiting"), F.count_if("is_inline_blob").alias("blobs"),
        F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set("importscripts_urls"))), lambda u: u.startswith("http"))).alias("external_imports"),
    )


def cors(docs: DataFrame) -> DataFrame:
    """(file_id, source_url, allow_origin): wildcard origin together with credentials; header names in lower case."""
    origin, credentials = F.try_element_at("headers", F.lit("access-control-allow-origin")), F.try_element_at("headers", F.lit("access-control-allow-credentials"))
    return docs.where((F.trim(origin) == "*") & (F.lower(F.trim(credentials)) == "true")).select("file_id", F.col("url").alias("source_url"), origin.alias("allow_origin"))


def dependencies(docs: DataFrame) -> DataFrame:
    """(file_id, file, name, version, is_old, line): the first banner of each known library in a document."""
    out = [Pattern(k, rx, 1) for k, (rx, _) in P.LIBRARIES.items()]
    rows = scan(docs, out).where("match_ord = 1")
    old = F.lit(False)
    for k, (_, prefixes) in P.LIBRARIES.items():
        old = F.when(F.col("name") == k, reduce(lambda a, b: a | b, [F.col("value").startswith(p) for p in prefixes])).otherwise(old)
    return rows.select("file_id", F.col("url").alias("file"), "name", F.col("value").alias("version"), old.alias("is_old"), "line")


def advisories(reports: DataFrame, payload: str = "payload") -> DataFrame:
    """(id columns, name, version, cves) from scanner reports: results, packages, vulnerabilities, aliases CVE-*.

    Packages without vulnerabilities and texts that are not such reports give no rows.
    """
    schema = "results array<struct<packages array<struct<package struct<name string, version string>, vulnerabilities array<struct<aliases array<string>>>>>>>"
    ids = [c for c in reports.columns if c != payload]
    packages = reports.select(*ids, F.explode(F.from_json(payload, schema)["results"]).alias("r")).select(*ids, F.explode("r.packages").alias("p")).where(F.size("p.vulnerabilities") > 0)
    aliases = F.flatten(F.transform("p.vulnerabilities", lambda v: F.coalesce(v["aliases"], F.array().cast("array<string>"))))
    return packages.select(*ids, F.coalesce("p.package.name", F.lit("")).alias("name"), F.coalesce("p.package.version", F.lit("")).alias("version"), F.filter(aliases, lambda a: a.startswith("CVE-")).alias("cves"))


def entropy_tokens(docs: DataFrame, known_hashes: DataFrame | None = None, least: float = 4.0, shortest: int = 20, most: int = 500) -> DataFrame:
    """(file_id, source_url, line, entropy_score, redacted_value, partial_hash): quoted tokens of high entropy.

    Hashes in ``known_hashes`` (partial_hash) are left out; a document keeps its first ``most`` tokens, which is the
    feature of the sweep, not a guard.
    """
    from pyspark.sql import Window

    token = Pattern("token", r"['\"]([A-Za-z0-9+/=_\-]{%d,})['\"]" % shortest, 1)
    rows = scan(docs, [token]).withColumn("entropy_score", X.entropy(F.col("value"))).where(F.col("entropy_score") >= least)
    rows = rows.withColumn("partial_hash", F.substring(F.sha2("value", 256), 1, 12))
    if known_hashes is not None:
        rows = rows.join(known_hashes.select("partial_hash").distinct(), "partial_hash", "left_anti")
    rows = first_wins(rows, ["file_id", "url", "partial_hash"])
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("match_ord"))
    shown = F.concat(F.left("value", F.lit(4)), F.repeat(F.lit("*"), F.length("value") - 8), F.right("value", F.lit(4)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("file_id", F.col("url").alias("source_url"), "line", "entropy_score", shown.alias("redacted_value"), "partial_hash")


# pages ------------------------------------------------------------------------------------------------------------


def html_links(pages: DataFrame) -> DataFrame:
    """(file_id, source_url, pattern_name, value): same-origin links and form targets as path and query."""
    page = F.col("url")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    links = scan(pages, [P.LINK]).select("file_id", "url", trimmed(F.col("value")).alias("ref"), F.lit("html_link").alias("pattern_name"))
    tags = scan(pages, [P.FORM])
    method = F.lower(F.regexp_extract("text", P.FORM_METHOD, 1))
    action = trimmed(F.regexp_extract("text", P.FORM_ACTION, 1))
    forms = tags.select("file_id", "url", F.when(action == "", page).otherwise(action).alias("ref"), F.when(method == "post", "html_form_post").otherwise("html_form_get").alias("pattern_name"))
    rows = links.unionByName(forms)
    skipped = reduce(lambda a, b: a | b, [F.col("ref").startswith(s) for s in P.SKIPPED_SCHEMES])
    rows = rows.where(~skipped).withColumn("target", X.resolve(page, F.col("ref"))).where(X.same_origin(F.col("target"), page))
    return rows.select("file_id", page.alias("source_url"), "pattern_name", X.path_and_query(F.col("target")).alias("value")).where("value <> ''").distinct()


def script_sources(pages: DataFrame) -> DataFrame:
    """(file_id, page_url, script_url): script references, resolved, each once per page."""
    return scan(pages, [P.SCRIPT_SRC]).select("file_id", F.col("url").alias("page_url"), X.resolve(F.col("url"), F.col("value")).alias("script_url")).distinct()


def third_party_scripts(pages: DataFrame) -> DataFrame:
    """(hostname, script_url, page_url): script references to another origin than the page's."""
    rows = script_sources(pages).where(~X.same_origin(F.col("script_url"), F.col("page_url")))
    return rows.select(X.hostname(F.col("script_url")).alias("hostname"), "script_url", "page_url").where("hostname <> ''").distinct()


def inline_scripts(pages: DataFrame) -> DataFrame:
    """(file_id, url, content): script bodies of a page as ``inline:<page>#script-N``; N counts all script tags.

    External scripts, other types than JavaScript and bodies under 20 characters are left out.
    """
    both = F.arrays_zip(X.all_values("content", P.SCRIPT_ATTRIBUTES).alias("a"), X.all_values("content", P.SCRIPT).alias("b"))
    rows = pages.where(X.has("content", P.SCRIPT)).select("file_id", "url", F.posexplode(both).alias("n", "s"))
    kind = F.regexp_extract("s.a", P.SCRIPT_TYPE, 1)
    body = F.regexp_replace("s.b", r"(?U)^\s+|\s+$", "")
    keep = ~F.col("s.a").rlike(P.SCRIPT_HAS_SRC) & ((kind == "") | F.lower(kind).isin(P.SCRIPT_TYPES)) & (F.length(body) >= P.SHORTEST_SCRIPT)
    return rows.where(keep).select("file_id", F.concat(F.lit("inline:"), "url", F.lit("#script-"), "n").alias("url"), body.alias("content"))


def source_map_refs(docs: DataFrame) -> DataFrame:
    """(file_id, url, map_url): where a script says its source map is, resolved."""
    ref = F.regexp_extract("content", P.SOURCE_MAP, 1)
    return docs.where(ref != "").select("file_id", "url", F.when(ref.rlike("^https?://"), ref).otherwise(X.resolve(F.col("url"), ref)).alias("map_url"))


def source_map_files(maps: DataFrame) -> DataFrame:
    """(file_id, url, content): sources that a source map embeds; pairs up to the shorter list, text ones only."""
    v = F.try_parse_json("content")
    pairs = F.arrays_zip(F.try_variant_get(v, "$.sources", "array<variant>").alias("s"), F.try_variant_get(v, "$.sourcesContent", "array<variant>").alias("c"))
    rows = maps.where(F.col("content").contains("sourcesContent")).select("file_id", "url", F.explode(pairs).alias("p"))
    is_text = lambda c: F.schema_of_variant(c) == "STRING"
    rows = rows.where(is_text(F.col("p.s")) & is_text(F.col("p.c")))
    path, body = F.try_variant_get("p.s", "$", "string"), F.try_variant_get("p.c", "$", "string")
    return rows.select("file_id", F.concat("url", F.lit(" (source map: "), path, F.lit(")")).alias("url"), body.alias("content")).where("content <> ''")


def url_kinds(urls: DataFrame) -> DataFrame:
    """(url, is_js, is_page): what a collected URL is worth fetching as."""
    js = F.col("url").rlike(P.JS_URL)
    return urls.select("url", js.alias("is_js"), (~js & ~F.col("url").rlike(P.ASSET_URL)).alias("is_page"))
