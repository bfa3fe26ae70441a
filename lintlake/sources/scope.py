"""Scope: which hosts and paths belong to a scan. The configuration is small and stays on the driver as literals."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import text as X


@dataclass(frozen=True)
class Scope:
    """Exact or ``*.`` patterns to include and exclude, and path globs to exclude."""

    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    excluded_paths: tuple[str, ...] = ()
    attested: bool = False
    settings: dict = field(default_factory=dict, hash=False)

    @property
    def bases(self) -> list[str]:
        return sorted({p[2:] if p.startswith("*.") else p for p in self.included})


def parse_text(text: str) -> Scope:
    """One pattern per line; ``#`` starts a comment, ``!`` an exclusion."""
    lines = [x.strip() for x in text.splitlines()]
    lines = [x for x in lines if x and not x.startswith("#")]
    return Scope(tuple(x for x in lines if x[0] != "!"), tuple(x[1:].strip() for x in lines if x[0] == "!"))


def parse_targets(targets: str) -> Scope:
    return Scope(tuple(x.strip() for x in targets.split(",") if x.strip()))


def parse_yaml(text: str) -> Scope:
    """The sections scope and authorization of a YAML configuration; needs a YAML library."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("a YAML scope needs a YAML library") from e
    raw = yaml.safe_load(text) or {}
    if raw.get("scope") is None:
        raise ValueError("missing section 'scope'")
    s = raw["scope"]
    named = tuple(("*." if x.get("type") == "wildcard" else "") + x["domain"] for x in s.get("in_scope") or [])
    attested = bool((raw.get("authorization") or {}).get("attested", False))
    return Scope(named, tuple(s.get("out_of_scope") or ()), tuple(s.get("excluded_paths") or ()), attested, raw.get("scan") or {})


def load(target: str | None = None, listing: str | None = None, config: str | None = None) -> Scope:
    """Exactly one of a target list, a text and a YAML text."""
    given = [x for x in (target, listing, config) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of target, listing and config")
    return parse_targets(target) if target is not None else parse_text(listing) if listing is not None else parse_yaml(config or "")


def _matches(host: Column, pattern: str) -> Column:
    pattern = pattern.lower()
    if pattern.startswith("*."):
        return (host == pattern[2:]) | host.endswith("." + pattern[2:])
    return host == pattern


def _glob(pattern: str) -> str:
    """A file-name pattern as an anchored regular expression; ``*`` also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif close > 0:
            inner = pattern[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^{out}$"


def decide(scope: Scope):
    """A function of a URL or host column: (allowed, reason) columns. Exclusions win over inclusions over paths."""

    def columns(u: Column) -> tuple[Column, Column]:
        host, path = X.hostname(u), X.path(u)
        none = F.lit(False)
        out = reduce(lambda a, b: a | b, [_matches(host, p) for p in scope.excluded], none)
        hit = reduce(lambda a, b: a | b, [_matches(host, p) for p in scope.included], none)
        bad = reduce(lambda a, b: a | b, [path.rlike(_glob(p)) for p in scope.excluded_paths], none)
        reason = (
            F.when(out, F.concat(F.lit("out-of-scope: "), host)).when(~hit, F.concat(F.lit("not in scope: "), host))
            .when(bad, F.concat(F.lit("excluded path: "), path)).otherwise(F.lit("in scope"))
        )
        return F.coalesce(~out & hit & ~bad, none), reason

    return columns


def decisions(urls: DataFrame, scope: Scope, column: str = "url") -> DataFrame:
    """(url, allowed, reason): one row per row; a null URL is not allowed."""
    allowed, reason = decide(scope)(F.col(column))
    return urls.select(F.col(column).alias("url"), allowed.alias("allowed"), reason.alias("reason"))


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """(url): lines of text files without blanks and ``#`` comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def collect(sources: list[DataFrame], scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Union of URL sources, split by scope: (allowed, denied) as distinct URLs."""
    every = reduce(lambda a, b: a.unionByName(b), [s.select("url") for s in sources])
    allowed, _ = decide(scope)(F.col("url"))
    marked = every.where("url is not null").distinct().withColumn("allowed", allowed)
    return marked.where("allowed").select("url"), marked.where("not allowed").select("url")
