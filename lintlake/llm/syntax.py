"""Source files that do not parse.

1. Each file is lexed into a row of token classes for the language that its URL promises, with the distinct pairs of
   adjacent classes. What the lexer can't read (an open string, a stray character, an unmatched bracket) is a fault.
2. The pairs, as rows, are anti-joined with the pairs that the language's productions permit; those are derived from
   the grammar, at most the square of some 80 classes for each language, and broadcast.
3. Nesting and productions: groups are reduced from the inside out and every flat window must fit a production.

Lexed rows are written to the shared folder once, since two steps read them; contents are never shuffled. No step gathers a repository: a hot
one is only counted, after partial aggregation. Null contents and other extensions are left out; an empty file is
valid except as JSON. File ids are taken as unique.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm import grammar_data, grammar_js, grammar_py
from lintlake.sources.tables import cut

LANGUAGES = {"js": "js", "mjs": "js", "ts": "ts", "json": "json", "py": "py", "yml": "yaml", "yaml": "yaml"}


def extension(url: Column) -> Column:
    """Extension of a URL's path, or of the path in ``<map url> (source map: <path>)``; case and query ignored."""
    mapped = F.regexp_extract(url, r"(?s)\(source map:\s*(.*?)\)\s*$", 1)
    path = F.when(mapped != "", mapped).otherwise(url)
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"(?s)[?#].*$", ""), r"\.([A-Za-z0-9]+)\s*$", 1))


def language(url: Column) -> Column:
    found = extension(url)
    out = F.lit(None).cast("string")
    for ext, lang in LANGUAGES.items():
        out = F.when(found == ext, lang).otherwise(out)
    return out


def lex(lang: str, text: str) -> tuple[str, str]:
    if lang == "py":
        return grammar_py.lex(text)
    if lang == "json":
        return grammar_data.lex_json(text)
    if lang == "yaml":
        return grammar_data.lex_yaml(text)
    return grammar_js.lex(text, lang == "ts")


@lru_cache(8)
def grammar(lang: str):
    if lang == "py":
        return grammar_py.grammar()
    if lang in ("js", "ts"):
        return grammar_js.grammar(lang == "ts")
    return grammar_data.JsonGrammar() if lang == "json" else grammar_data.YamlGrammar()


def windows(lang: str, tokens: str) -> list[str]:
    """Runs of tokens within which neighbours are held against the grammar; ``^`` and ``$`` mark known ends."""
    if lang == "py":
        return [f"^{x}$" for x in re.split("[\n⇥⇤]+", tokens) if x]
    if lang == "yaml":
        return [f"^{x}$" for x in re.sub("[<>]", "", tokens).split("\n") if x]
    return f"^{tokens}$".split("\n")


def adjacent_pairs(lang: str, tokens: str) -> set[str]:
    return {x[i : i + 2] for x in windows(lang, tokens) for i in range(len(x) - 1)}


@lru_cache(1)
def _permitted() -> list[tuple[str, str]]:
    return [(lang, a + b) for lang in sorted(set(LANGUAGES.values())) for a, b in sorted(grammar(lang).pairs())]


def permissible(spark: SparkSession) -> DataFrame:
    """(lang, pair) for every pair of adjacent tokens that a production permits."""
    rows = _permitted()
    return spark.createDataFrame(rows, "lang string, pair string")


def lexed_files(files: DataFrame) -> DataFrame:
    """(file_id, lang, tokens, error, pairs) of every file with contents and a known language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, lang, text in zip(b["file_id"], b["lang"], b["content"]):
                tokens, error = lex(lang, text)
                rows.append((i, lang, tokens, error, [] if error else sorted(adjacent_pairs(lang, tokens))))
            yield pd.DataFrame(rows, columns=["file_id", "lang", "tokens", "error", "pairs"])

    known = files.select("file_id", language(F.col("url")).alias("lang"), "content").where("lang is not null and content is not null")
    kind = files.schema["file_id"].dataType.simpleString()
    return known.mapInPandas(run, f"file_id {kind}, lang string, tokens string, error string, pairs array<string>")


@F.pandas_udf(T.StringType())
def production_fault(lang: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([grammar(a).fault(b) for a, b in zip(lang, tokens)])


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, lang, fault): files that do not parse, each once, with the first fault found."""
    spark = files.sparkSession
    rows = cut(lexed_files(files))
    by_lexer = rows.where("error <> ''").select("file_id", "lang", F.concat(F.lit("1 lexer: "), "error").alias("fault"))
    clean = rows.where("error = ''")
    pairs = clean.select("file_id", "lang", F.explode("pairs").alias("pair"))
    by_pair = pairs.join(F.broadcast(permissible(spark)), ["lang", "pair"], "left_anti").select(
        "file_id", "lang", F.concat(F.lit("2 tokens side by side: "), "pair").alias("fault")
    )
    by_production = (
        clean.select("file_id", "lang", production_fault("lang", "tokens").alias("fault"))
        .where("fault <> ''")
        .select("file_id", "lang", F.concat(F.lit("3 production: "), "fault").alias("fault"))
    )
    return by_lexer.unionByName(by_pair).unionByName(by_production).groupBy("file_id", "lang").agg(F.min("fault").alias("fault"))


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repo, lang, files, invalid, rate) over all files with contents and a known language; a null repo is one group."""
    bad = invalid_files(files).select("file_id", F.lit(1).alias("bad"))
    known = files.select("file_id", "repo", language(F.col("url")).alias("lang"), "content").where(
        "lang is not null and content is not null"
    )
    joined = known.select("file_id", "repo", "lang").join(bad, "file_id", "left")
    return joined.groupBy("repo", "lang").agg(
        F.count(F.lit(1)).alias("files"), F.count("bad").alias("invalid"), (F.count("bad") / F.count(F.lit(1))).alias("rate")
    )
