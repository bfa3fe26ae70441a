"""Operators over finding tables: deduplication, tags, groups, sets, graphs, candidates, diffs and counters.

Flags from other tables are joined as distinct keys; Catalyst broadcasts them where their measured size allows and
shuffles them where it does not. Aggregations combine map-side. Ties are decided by an order column, never by the
order in which rows happen to arrive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lintlake.functions import patterns as P
from lintlake.functions import text as X
from lintlake.operators.extract import _flag_any, scan


def normalized(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last one's values, with ``first_order``, the place of the first. Nulls equal nulls."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order and not _is_map(rows, c)])).alias("_b"), F.min(order).alias("first_order"))
    return best.select(*keys, "_b.*", "first_order")


def _is_map(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() == "map"


def environment(source_url: Column) -> Column:
    """dev, staging, prod or unknown by the host's labels; dev is tried first."""
    host = X.hostname(source_url)
    known = source_url.contains("://") & (host != "")
    return F.when(known & host.rlike(P.ENV_DEV), "dev").when(known & host.rlike(P.ENV_STAGING), "staging").when(known, "prod").otherwise("unknown")


def tag_endpoints(endpoints: DataFrame, collected: DataFrame, historical: DataFrame, auth_only: DataFrame, runtime_paths: DataFrame) -> DataFrame:
    """Endpoints with ``tag`` and ``environment``: auth-required, then live at runtime, then historical, else live.

    collected (url), historical (value), auth_only (url), runtime_paths (path); each is used as a set.
    """
    path = F.when(F.col("value").startswith("/"), F.col("value")).otherwise(F.concat(F.lit("/"), F.regexp_replace("value", "^/+", "")))
    e = endpoints.drop("tag", "environment").withColumn("_path", path)
    live = collected.select(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("_path")).distinct().withColumn("_live", F.lit(True))
    e = e.join(auth_only.select(F.col("url").alias("source_url")).distinct().withColumn("_auth", F.lit(True)), "source_url", "left")
    e = e.join(runtime_paths.select(F.col("path").alias("_path")).distinct().withColumn("_run", F.lit(True)), "_path", "left")
    e = e.join(live, "_path", "left").join(historical.select("value").distinct().withColumn("_old", F.lit(True)), "value", "left")
    tag = F.when(F.col("_auth"), "auth-required").when(F.col("_run"), "live").when(F.col("_old") | F.col("_live").isNull(), "historical").otherwise("live")
    return e.withColumns({"tag": tag, "environment": environment(F.col("source_url"))}).drop("_path", "_auth", "_run", "_live", "_old")


def api_group(value: Column) -> Column:
    """The first group with a key word in the path; ``api`` for others below /api/, else general."""
    low = F.lower(value)
    out = F.when(low.contains("/api/"), "api").otherwise("general")
    for name, words in reversed(P.API_GROUPS.items()):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name).otherwise(out)
    return out


def api_groups(endpoints: DataFrame) -> DataFrame:
    """(group_name, endpoints, old_versions): counts of distinct paths and of those whose next version is there too.

    Groups are few and may each hold most rows, so paths are counted, not gathered; ``api_group_members`` has them.
    """
    return api_group_members(endpoints).groupBy("group_name").agg(F.count(F.lit(1)).alias("endpoints"), F.count_if("is_old_version").alias("old_versions"))


def api_group_members(endpoints: DataFrame) -> DataFrame:
    """(group_name, value, is_old_version): distinct paths; old if the path with version + 1 also exists."""
    values = endpoints.where("value is not null").select("value").distinct()
    version = F.regexp_extract("value", r"/v(\d+)/", 1)
    newer = F.regexp_replace("value", F.lit(r"/v\d+/"), F.concat(F.lit("/v"), (version.try_cast("decimal(38,0)") + 1).cast("string"), F.lit("/")))
    marked = values.withColumn("_newer", F.when(version != "", newer))
    there = values.select(F.col("value").alias("_newer")).withColumn("_there", F.lit(True))
    return marked.join(there, "_newer", "left").select(api_group(F.col("value")).alias("group_name"), "value", F.coalesce("_there", F.lit(False)).alias("is_old_version"))


def endpoint_identifier(value: Column) -> Column:
    """Name of the object identifier in a path or query, ``id`` for a numeric path, else null."""
    named = F.coalesce(F.nullif(F.regexp_extract(value, P.PATH_IDENTIFIER, 1), F.lit("")), F.nullif(F.regexp_extract(value, P.PATH_IDENTIFIER, 2), F.lit("")))
    query = F.nullif(F.regexp_extract(value, P.QUERY_IDENTIFIER, 1), F.lit(""))
    return F.coalesce(named, query, F.when(value.rlike(P.NUMERIC_PATH), F.lit("id")))


def object_access(endpoints: DataFrame, parameters: DataFrame, docs: DataFrame) -> DataFrame:
    """(endpoint, identifier, function_name, sensitive_properties, level, bug_class, source_url) candidates.

    endpoints (ord, value, source_url), parameters (ord, name, source_url, function_name), docs (ord, url, content).
    Object access: one per endpoint and identifier, the first in order across sources. Privileged paths: one per
    endpoint. Spread into a request with sensitive properties: one per document. Only derived properties of a
    document are joined, never its content.
    """
    found = F.slice(F.array_distinct(X.all_values("content", P.SENSITIVE_PROPERTY)), 1, 10)
    props = docs.where("content is not null").groupBy("url").agg(F.max_by(F.struct(found.alias("p"), _flag_any(P.SPREADS).alias("spread"), F.col("ord")), "ord").alias("d")).select(F.col("url").alias("source_url"), "d.p", "d.spread", F.col("d.ord").alias("doc_ord"))
    ids = endpoints.withColumn("identifier", endpoint_identifier(F.col("value")))
    objects = ids.where("identifier is not null").groupBy(F.col("value").alias("endpoint"), "identifier").agg(F.min_by("source_url", "ord").alias("source_url"))
    by_name = parameters.groupBy("source_url", F.lower("name").alias("_n")).agg(F.min_by(F.struct("function_name"), "ord").alias("_f"))
    objects = objects.withColumn("_n", F.lower("identifier")).join(by_name, ["source_url", "_n"], "left").join(props.select("source_url", "p"), "source_url", "left")
    sensitive = F.coalesce("p", F.array().cast("array<string>"))
    level = F.when(F.col("_n").isin(P.CROSS_TENANT), 4).when(F.size(sensitive) > 0, 3).when(F.col("_f.function_name").isNotNull(), 2).otherwise(1)
    cols = ["endpoint", "identifier", "function_name", "sensitive_properties", "level", "bug_class", "source_url"]
    a = objects.select("endpoint", "identifier", F.col("_f.function_name").alias("function_name"), sensitive.alias("sensitive_properties"), level.alias("level"), F.lit("BOLA").alias("bug_class"), "source_url")
    privileged = endpoints.where(F.col("value").rlike(P.PRIVILEGED)).groupBy(F.col("value").alias("endpoint")).agg(F.min_by("source_url", "ord").alias("source_url"))
    any_function = parameters.where("function_name is not null").groupBy("source_url").agg(F.min_by("function_name", "ord").alias("function_name"))
    b = privileged.join(any_function, "source_url", "left").select("endpoint", F.lit("privileged_path").alias("identifier"), "function_name", F.array().cast("array<string>").alias("sensitive_properties"), F.lit(2).alias("level"), F.lit("BFLA").alias("bug_class"), "source_url")
    first = endpoints.groupBy("source_url").agg(F.min_by("value", "ord").alias("endpoint"))
    c = props.where("spread and size(p) > 0").join(first, "source_url", "left").select(F.coalesce("endpoint", "source_url").alias("endpoint"), F.lit("spread_pattern").alias("identifier"), F.lit(None).cast("string").alias("function_name"), F.col("p").alias("sensitive_properties"), F.lit(3).alias("level"), F.lit("mass_assignment").alias("bug_class"), "source_url")
    return a.select(cols).unionByName(b.select(cols)).unionByName(c.select(cols))


def bundler(content: Column) -> Column:
    """webpack, vite, next or unknown: most signals, ties in that order."""
    ranked = []
    for rank, (name, rx) in enumerate(reversed(P.BUNDLERS.items())):
        signals = reduce(lambda a, b: a + b, [F.when(content.rlike(r), 1).otherwise(0) for r in rx])
        ranked.append(F.struct(signals.alias("n"), F.lit(rank).alias("rank"), F.lit(name).alias("name")))
    best = F.array_max(F.array(F.struct(F.lit(0).alias("n"), F.lit(9).alias("rank"), F.lit("unknown").alias("name")), *ranked))
    return best["name"]


_NODE = "array<struct<place:int,chunk_url:string,chunk_name:string,static_imports:array<string>,dynamic_imports:array<string>>>"


def asset_nodes(docs: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(chunk_url, chunk_name, bundler, static_imports, dynamic_imports, source_url): one node per chunk, first file wins.

    docs (ord, url, content). Webpack and plain files give a root node with their imports, webpack also named chunks
    (the name stands in the call or in the 80 characters before it); Vite and Next give a node per chunk. All of a
    document's nodes are made in one pass. manifests (ord, url, content) hold Vite manifests and come first.
    """
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")

    def node(place: Column, url: Column, name: Column, static: Column, dynamic: Column) -> Column:
        return F.struct(place.cast("int").alias("place"), url.alias("chunk_url"), name.alias("chunk_name"), static.alias("static_imports"), dynamic.alias("dynamic_imports"))

    static, dynamic = (F.array_distinct(X.all_values("content", p)) for p in (P.STATIC_IMPORT, P.DYNAMIC_IMPORT))
    quick = F.col("content").rlike(r"import|require\.ensure|/_next/static/chunks/")
    base = docs.where(quick).select("ord", "url", "content", bundler(F.col("content")).alias("bundler"), static.alias("static"), dynamic.alias("dynamic"))

    ensured = F.flatten(F.transform(X.all_values("content", P.REQUIRE_ENSURE), lambda c: F.regexp_extract_all(c, F.lit(P.QUOTED_URL), F.lit(1))))
    calls = F.regexp_extract_all("content", F.lit(P.DYNAMIC_IMPORT.java), F.lit(0))
    gaps = F.split("content", P.DYNAMIC_IMPORT.java, -1)
    pieces = F.zip_with(F.slice(gaps, 1, F.size(calls)), calls, lambda g, t: F.concat(g, t))

    def named_chunk(x: Column, i: Column) -> Column:
        before = F.concat(F.array_join(F.slice(pieces, F.greatest(F.lit(1), i - 7), F.least(i, F.lit(8))), ""), F.get(gaps, i))
        name = F.nullif(F.regexp_extract(F.concat(F.right(before, F.lit(80)), x["t"]), P.CHUNK_NAME, 1), F.lit(""))
        return node(i + 1, x["v"], name, empty, empty)

    every = X.all_values("content", P.DYNAMIC_IMPORT)
    zipped = F.arrays_zip(calls.alias("t"), every.alias("v"))
    named = F.filter(F.transform(zipped, named_chunk), lambda n: n["chunk_name"].isNotNull() & (F.array_position(every, n["chunk_url"]) == n["place"]))
    listed = F.when(F.col("bundler") == "webpack", F.array_distinct(F.concat("dynamic", ensured))).otherwise(F.col("dynamic"))
    root = F.when((F.size("static") > 0) | (F.size(listed) > 0), F.array(node(F.lit(0), F.col("url"), none, F.col("static"), listed)))
    preloads = F.array_distinct(F.concat(X.all_values("content", P.VITE_PRELOAD), F.col("dynamic")))
    vite = F.transform(preloads, lambda u, i: node(i, u, none, F.when(i == 0, F.col("static")).otherwise(empty), empty))
    own = F.transform(F.array_distinct(X.all_values("content", P.NEXT_CHUNK)), lambda c: F.struct(F.concat(F.lit("/_next/static/chunks/"), c).alias("u"), F.regexp_replace(c, r"(?:\.[^.]*)?\.[^.]*$", "").alias("n")))
    other = F.transform(F.col("dynamic"), lambda u: F.struct(u.alias("u"), none.alias("n")))
    next_ = F.transform(F.concat(own, other), lambda x, i: node(i, x["u"], x["n"], empty, empty))
    nothing = F.array().cast(_NODE)
    nodes = (
        F.when(F.col("bundler") == "vite", vite).when(F.col("bundler") == "next", next_)
        .when(F.col("bundler") == "webpack", F.concat(F.coalesce(root, nothing), named)).otherwise(F.coalesce(root, nothing))
    )
    out = base.select("ord", "url", "bundler", F.explode(nodes).alias("n")).select("ord", "n.*", "bundler", F.col("url").alias("source_url"))
    cols = ["ord", "place", "chunk_name", "bundler", "static_imports", "dynamic_imports", "source_url"]
    if manifests is not None:
        entry = F.from_json("content", "map<string,struct<file:string,imports:array<string>,dynamicImports:array<string>>>")
        m = manifests.select("ord", "url", F.explode(entry).alias("k", "v")).where("v.file <> ''")
        out = out.unionByName(m.select(
            (F.col("ord") - F.lit(1 << 60)).alias("ord"), F.lit(0).alias("place"), F.col("v.file").alias("chunk_url"), F.col("k").alias("chunk_name"), F.lit("vite").alias("bundler"),
            F.coalesce("v.imports", empty).alias("static_imports"), F.coalesce("v.dynamicImports", empty).alias("dynamic_imports"), F.col("url").alias("source_url"),
        ))
    best = out.groupBy("chunk_url").agg(F.min(F.struct(*cols)).alias("b"))
    return best.select("chunk_url", *[f"b.{c}" for c in cols[2:]])


def asset_edges(nodes: DataFrame) -> DataFrame:
    """(source, target, relation): imports of every node."""
    static = nodes.select(F.col("chunk_url").alias("source"), F.explode("static_imports").alias("target"), F.lit("static").alias("relation"))
    return static.unionByName(nodes.select(F.col("chunk_url").alias("source"), F.explode("dynamic_imports").alias("target"), F.lit("dynamic").alias("relation")))


def asset_summary(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(bundler, total_chunks, has_dynamic_imports): the dominant bundler by files plus nodes; ties by name order given."""
    files = docs.where("content is not null").select(bundler(F.col("content")).alias("bundler"))
    votes = files.unionByName(nodes.select("bundler")).where("bundler <> 'unknown'").groupBy("bundler").agg(F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col("bundler") == "webpack", 3).when(F.col("bundler") == "vite", 2).otherwise(1)
    top = votes.agg(F.max_by("bundler", F.struct("n", rank.alias("r"))).alias("bundler"))
    totals = nodes.agg(F.count(F.lit(1)).alias("total_chunks"), F.coalesce(F.bool_or(F.size("dynamic_imports") > 0), F.lit(False)).alias("has_dynamic_imports"))
    return totals.join(top, how="full", on=F.lit(True)).select(F.coalesce("bundler", F.lit("unknown")).alias("bundler"), "total_chunks", "has_dynamic_imports")


def graph(files: DataFrame, families: dict[str, tuple[DataFrame, Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node per source and per finding, an edge from source to finding.

    ``families`` maps a kind to (findings with source_url, id column, relation). Sources with a file are bundles.
    """
    parts = [df.select(F.lit(kind).alias("kind"), F.concat(F.lit(kind + ":"), key).alias("id"), "source_url", F.lit(rel).alias("relation")).distinct() for kind, (df, key, rel) in families.items()]
    found = reduce(lambda a, b: a.unionByName(b), parts)
    urls = files.select("url").distinct()
    sources = urls.withColumn("kind", F.lit("bundle")).unionByName(found.select(F.col("source_url").alias("url"), F.lit("url").alias("kind")))
    sources = sources.where("url is not null").groupBy("url").agg(F.min("kind").alias("kind"))
    nodes = sources.select(F.concat(F.lit("source:"), "url").alias("id"), "kind").unionByName(found.select("id", "kind").distinct())
    edges = found.where("source_url is not null").select(F.concat(F.lit("source:"), "source_url").alias("source"), F.col("id").alias("target"), "relation")
    return nodes, edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_count, edge_count, bundle_count)."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("kind") == "bundle").alias("bundle_count"))
    return n.join(edges.agg(F.count(F.lit(1)).alias("edge_count")), how="inner", on=F.lit(True)).select("node_count", "edge_count", "bundle_count")


def set_comparison(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """(value, side): left_only, right_only or both, over distinct non-null values."""
    a = left.select(F.col(value).alias("value"), F.lit(1).alias("m"))
    b = right.select(F.col(value).alias("value"), F.lit(2).alias("m"))
    bits = a.unionByName(b).where("value is not null").groupBy("value").agg(F.bit_or("m").alias("m"))
    return bits.select("value", F.when(F.col("m") == 1, "left_only").when(F.col("m") == 2, "right_only").otherwise("both").alias("side"))


def response_diff(pairs: DataFrame) -> DataFrame:
    """Comparison of two captured responses per row: (id, status_match, body_length_delta, keys_added, keys_removed,
    sensitive_fields, suggestion) from (id, base_status, base_body, test_status, test_body). Keys count only if both
    bodies are JSON objects; null bodies are empty."""
    keys = lambda c: F.json_object_keys(F.when(F.col(c).rlike(r"^\s*\{"), F.when(F.try_parse_json(c).isNotNull(), F.col(c))))
    rows = pairs.select(
        "id", "test_status", (F.col("base_status") == F.col("test_status")).alias("status_match"), (F.length(F.coalesce("test_body", F.lit(""))) - F.length(F.coalesce("base_body", F.lit("")))).alias("body_length_delta"),
        keys("base_body").alias("b"), keys("test_body").alias("t"),
    )
    none = F.array().cast("array<string>")
    both = F.col("b").isNotNull() & F.col("t").isNotNull()
    sensitive = F.filter("t", lambda k: reduce(lambda a, b: a | b, [F.lower(k).contains(w) for w in P.SENSITIVE_FIELDS]))
    rows = rows.select(
        "id", "test_status", "status_match", "body_length_delta", both.alias("objects"),
        *[F.when(both, F.array_sort(F.array_distinct(c))).otherwise(none).alias(n) for n, c in (("keys_added", F.array_except("t", "b")), ("keys_removed", F.array_except("b", "t")), ("sensitive_fields", sensitive))],
    )
    same = F.col("status_match") & F.col("objects") & (F.size("keys_added") == 0) & (F.size("keys_removed") == 0) & (F.size("sensitive_fields") > 0)
    suggestion = F.when(~F.col("status_match") & F.col("test_status").isin(401, 403, 404), "denied").when(same, "same_shape_sensitive").when(F.col("status_match"), "same_status").otherwise("status_differs")
    return rows.select("id", "status_match", "body_length_delta", "keys_added", "keys_removed", "sensitive_fields", suggestion.alias("suggestion"))


def interest_scores(families: dict[str, DataFrame]) -> DataFrame:
    """(source_url, score and a count per family): findings per source, weighted. One shuffle of counted rows."""
    parts = [df.where("source_url is not null").groupBy("source_url").agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.lit(k)) for k, df in families.items()]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    counts = [F.coalesce(F.sum(F.when(F.col("family") == k, F.col("n"))), F.lit(0)).alias(k) for k in families]
    wide = every.groupBy("source_url").agg(*counts)
    score = reduce(lambda a, b: a + b, [F.col(k) * P.INTEREST_WEIGHTS.get(k, 1) for k in families])
    return wide.withColumn("score", score)


def path_template(value: Column) -> Column:
    """Parameters and numbers of three digits or more as a placeholder."""
    return F.regexp_replace(F.regexp_replace(value, P.PLACEHOLDER_PATH, "/REPLACE_ID"), r"(/)\d{3,}", "$1REPLACE_ID")


def increment_last_number(value: Column) -> Column:
    """The rightmost run of digits plus one, leading zeros dropped; null without digits or beyond 38 of them."""
    rx = r"(?s)^(.*?)(\d+)(\D*)$"
    number = F.regexp_extract(value, rx, 2)
    bumped = F.when(F.length(number) < 38, (number.try_cast("decimal(38,0)") + 1).cast("string"))
    return F.when(number != "", F.concat(F.regexp_extract(value, rx, 1), bumped, F.regexp_extract(value, rx, 3)))


def url_slug(url: Column) -> Column:
    slug = F.right(F.regexp_replace(url, r"[^A-Za-z0-9_.\-]", "_"), F.lit(120))
    return F.when(slug.endswith(".js"), slug).otherwise(F.concat(slug, F.lit(".js")))


def template_matches(values: DataFrame, paths: DataFrame) -> DataFrame:
    """Values that a runtime path confirms, literally or as a template of segments.

    A template's shape is its number of segments and the places of its parameters. A path is written with those places
    blank in every shape of its length that has the same first fixed segment, and values meet it by equality; one
    without parameters meets the path as it stands. Work grows with paths times shapes, never with paths times values.
    """
    wild = r"(?::\w+|\{\w+\})"
    blanked = lambda s, at: F.concat(F.array_join(at.cast("array<string>"), ","), F.lit(":"), F.array_join(F.transform(s, lambda x, i: F.when(F.array_contains(at, i), "").otherwise(x)), "/"))

    whole = F.when(F.col("value").startswith("/"), F.col("value")).otherwise(F.concat(F.lit("/"), F.col("value")))
    path = F.substring_index(F.substring_index(whole, "?", 1), "#", 1)
    template = F.col("_p").rlike(rf"/{wild}(?:/|\z)")
    places = F.filter(F.transform(F.split("_p", "/"), lambda s, i: F.when(s.rlike(rf"^{wild}\z"), i)), lambda i: i.isNotNull())
    fixed = F.filter(F.transform(F.split("_p", "/"), lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: (x["s"] != "") & ~F.array_contains("_w", x["i"]))
    shapes = values.select(path.alias("_p")).where(template).withColumn("_w", places).withColumn("_f", F.get(fixed, 0))
    shapes = shapes.select(F.size(F.split("_p", "/")).alias("_n"), F.coalesce("_f.i", F.lit(0)).alias("_at"), F.coalesce("_f.s", F.lit("")).alias("_first"), "_w").distinct()

    seen = paths.select("path").distinct()
    r = seen.select("path", F.posexplode(F.split("path", "/")).alias("_at", "_first")).where("_first <> '' or _at = 0").withColumn("_n", F.size(F.split("path", "/")))
    r = r.join(shapes, ["_n", "_at", "_first"]).withColumn("_r", F.split("path", "/")).where(F.forall("_w", lambda i: F.get("_r", i) != ""))
    keys = r.select(blanked(F.col("_r"), F.col("_w")).alias("_key")).distinct().unionByName(seen.select(F.concat(F.lit(":"), "path").alias("_key")))
    v = values.select("value").distinct().withColumn("_p", path).withColumn("_w", F.when(template, places))
    v = v.withColumn("_key", F.when(F.col("_w").isNull(), F.concat(F.lit(":"), "_p")).otherwise(blanked(F.split("_p", "/"), F.col("_w"))))
    return v.join(keys, "_key", "left_semi").select("value")


def unresolved_citations(citing: DataFrame, cited: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Citations of evidence that does not exist; a valid set has none."""
    return citing.select(key).distinct().join(cited.select(key).distinct(), key, "left_anti")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows numbered into batches of ``size`` in the given order, with ranks from range-partitioned counts.

    Sorted partitions are numbered locally and shifted by the rows before them; only one count per partition is
    gathered, so no task sees all rows.
    """
    placed = rows.orderBy(order, *[c for c in rows.columns if c != order and not _is_map(rows, c)]).withColumn("_pid", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    from lintlake.sources.tables import cut

    placed = cut(placed)
    counts = {r._pid: r.n for r in placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, shift = 0, []
    for pid in sorted(counts):
        shift.append((pid, before))
        before += counts[pid]
    shifts = rows.sparkSession.createDataFrame(shift or [(0, 0)], "_pid int, _before bigint")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_pid").orderBy("_k"))
    return placed.join(F.broadcast(shifts), "_pid").withColumn("batch", F.floor((rank - 1) / size)).drop("_pid", "_k", "_before")


def evidence_items(endpoints: DataFrame) -> DataFrame:
    """(evidence_id, pattern_name, value, source_url, injection_suspected)."""
    odd = lambda c: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike("(?i)" + r), F.lit(False)) for r in P.INJECTIONS])
    return endpoints.select(
        X.stable_id(F.col("pattern_name"), F.col("value"), F.col("source_url")).alias("evidence_id"), "pattern_name", "value", "source_url", (odd("value") | odd("source_url")).alias("injection_suspected")
    ).distinct()


def unsafe_texts(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text has a prohibited phrase."""
    low = F.lower(column)
    return rows.where(reduce(lambda a, b: a | b, [low.contains(w) for w in P.UNSAFE_WORDS]))


def top_by(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in an order: a top-k per partition and one merge of k rows each."""
    return rows.orderBy(*order).limit(k)


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}.items() for x in kv]), c), F.lit(99))


def review_queue(candidates: DataFrame, endpoints: DataFrame, operations: DataFrame) -> DataFrame:
    """(section, place, item): object access by level, privileged routes, 30 auth-required endpoints, 5 GraphQL
    endpoints, 50 others. The caps are the report's own; each section takes its first rows in a stated order."""
    def section(df: DataFrame, name: str, item: Column, order: list[Column], k: int | None) -> DataFrame:
        best = df.select(item.alias("item"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]).groupBy("item").agg(F.min(F.struct(*[f"_o{i}" for i in range(len(order))])).alias("_o"))
        best = best.orderBy("_o", "item")
        return (best.limit(k) if k else best).select(F.lit(name).alias("section"), "item")

    objects = section(candidates.where("bug_class = 'BOLA'"), "1 object access", path_template(F.col("endpoint")), [-F.col("level")], None)
    privileged = section(candidates.where("bug_class = 'BFLA'"), "2 privileged", F.col("endpoint"), [F.lit(0)], None)
    auth = section(endpoints.where("tag = 'auth-required'"), "3 auth-required", path_template(F.col("value")), [F.col("value")], 30)
    gql = section(operations, "4 graphql", F.col("endpoint"), [F.col("endpoint")], 5)
    used = candidates.select(F.col("endpoint").alias("value")).unionByName(endpoints.where("tag = 'auth-required'").select("value")).distinct()
    rest = section(endpoints.where("tag in ('live', 'historical')").join(used, "value", "left_anti"), "5 others", path_template(F.col("value")), [F.col("value")], 50)
    return reduce(lambda a, b: a.unionByName(b), [objects, privileged, auth, gql, rest])
