"""Credentials embedded in source code: found, described and masked.

Tokens of every file are labelled by a linear-chain conditional random field (``secret_crf``); its Viterbi spans are
the characters that count as the credential and the only ones that are masked. The model is trained on the driver
from a seeded generator (its size is a parameter) and broadcast: 65,536 slots by 3 labels, 0.8 MB whatever the data.
One narrow pass over the files; nothing is shuffled but the (file, hash) rows that are made distinct.

The raw value never leaves the task: rows carry its type, a preview and the first 12 hex digits of its SHA-256.
Null contents give no rows and stay null when masked; a value that stands twice in a file is one credential.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import secret_crf
from lintlake.llm.secret_tokens import FORMATS, Token, features, name_parts, tokens, windows

_JWT_NONE = re.compile(r'"alg"\s*:\s*"none"', re.I)
_FORMAT_RX = {k: re.compile(v) for k, v in FORMATS.items()}
_BY_NAME = (
    ("hardcoded_password", {"password", "passwd", "pwd", "pass", "pw", "passphrase"}),
    ("licence_key", {"license", "licence", "serial", "activation", "product"}),
    ("signing_secret", {"signing", "hmac", "signature"}),
    ("client_secret", {"client", "app", "oauth", "consumer", "webhook", "shared"}),
    ("generic_bearer_token", {"token", "bearer"}),
    ("generic_api_key_assignment", {"api", "key", "apikey"}),
)


#: Files whose windows are labelled together; the result of a file does not depend on it.
TOGETHER = 64


def find_all(crf: secret_crf.Crf, texts: list[str]) -> list[list[tuple[Token, str]]]:
    """(token, type) of every labelled credential of each text, in order.

    A further literal of a file with exactly the text of a labelled one is a span of its own; the same word as a bare
    name of the code, or as part of something else, is none.
    """
    runs: list[list[Token]] = []
    owner: list[int] = []
    lexed = [tokens(x) for x in texts]
    for i, ts in enumerate(lexed):
        for w in windows(ts):
            runs.append(w)
            owner.append(i)
    out: list[list[tuple[Token, str]]] = [[] for _ in texts]
    for i, w, ys in zip(owner, runs, crf.label([[features(w, k) for k in range(len(w))] for w in runs])):
        out[i] += [(w[k], secret_type(w, k)) for k, y in enumerate(ys) if y == 2]
    for i, found in enumerate(out):
        kinds = {t.text: what for t, what in reversed(found)}
        if kinds:
            seen = {t.start for t, _ in found}
            found += [(t, kinds[t.text]) for t in lexed[i] if t.text in kinds and t.start not in seen and (t.alone or t.kind in ("value", "pass", "pem"))]
            found.sort(key=lambda x: x[0].start)
    return out


def find(crf: secret_crf.Crf, text: str) -> list[tuple[Token, str]]:
    return find_all(crf, [text])[0]


def _in_parts(texts: list[str]) -> Iterator[list[str]]:
    for at in range(0, len(texts), TOGETHER):
        yield texts[at : at + TOGETHER]


def secret_type(window: list[Token], k: int) -> str:
    """Type by format, then by the scheme word or name before the value."""
    t = window[k]
    if t.kind == "pem":
        return "private_key_block"
    if t.kind == "pass":
        return "connection_password"
    for name, rx in _FORMAT_RX.items():
        if rx.fullmatch(t.text):
            if name == "jwt_token":
                head = t.text.split(".")[0]
                try:
                    if _JWT_NONE.search(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)).decode("utf-8", "replace")):
                        return "jwt_alg_none"
                except ValueError:
                    pass
            return name
    before = window[k - 1].text if k else ""
    if before in ("Basic", "basic"):
        return "basic_auth_header"
    if before in ("Bearer", "bearer", "Token", "token"):
        return "generic_bearer_token"
    parts = set(name_parts(before))
    for kind, words in _BY_NAME:
        if parts & words:
            return kind
    return "generic_secret"


def partial_hash(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def preview(value: str) -> str:
    """First and last four characters, the rest masked; short values show less, line ends none."""
    value = re.sub(r"\s", " ", value)
    keep = 4 if len(value) >= 16 else 2 if len(value) >= 8 else 0
    return value[:keep] + "*" * min(len(value) - 2 * keep, 40) + value[len(value) - keep :]


def mask(text: str, found: list[tuple[Token, str]]) -> str:
    """``text`` with only the characters of the spans masked, each by one ``*``; line ends stay, and all else as it was."""
    out, at = [], 0
    for t, _ in sorted(found, key=lambda x: x[0].start):
        out += [text[at : t.start], re.sub(r"[^\r\n]", "*", text[max(at, t.start) : t.end])]
        at = max(at, t.end)
    return "".join([*out, text[at:]])


def shared_model(spark: SparkSession, examples: int = secret_crf.EXAMPLES, seed: int = 7) -> Broadcast:
    return spark.sparkContext.broadcast(secret_crf.model(examples, seed))


SEVERITY = {"private_key_block": "critical", "stripe_live_key": "critical", "jwt_alg_none": "critical", "aws_access_key": "high", "github_token": "high", "hardcoded_password": "high", "connection_password": "high"}


def secrets(files: DataFrame, examples: int = secret_crf.EXAMPLES) -> DataFrame:
    """(file_id, secret_type, severity, redacted_value, partial_hash): one row per file and distinct credential."""
    crf = shared_model(files.sparkSession, examples)
    kind = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["file_id", "secret_type", "severity", "redacted_value", "partial_hash"]
        for b in batches:
            rows = []
            found = (x for part in _in_parts(list(b["content"])) for x in find_all(crf.value, part))
            for i, spans in zip(b["file_id"], found):
                seen: set[str] = set()
                for t, what in spans:
                    h = partial_hash(t.text)
                    if h not in seen:
                        seen.add(h)
                        rows.append((i, what, SEVERITY.get(what, "medium"), preview(t.text), h))
            yield pd.DataFrame(rows, columns=cols)

    schema = f"file_id {kind}, secret_type string, severity string, redacted_value string, partial_hash string"
    return files.select("file_id", "content").where(F.col("content").isNotNull()).mapInPandas(run, schema)


def redacted(files: DataFrame, examples: int = secret_crf.EXAMPLES) -> DataFrame:
    """(file_id, content): every file with its credentials masked, all other characters as they were."""
    crf = shared_model(files.sparkSession, examples)
    kind = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["content"])
            found = (x for part in _in_parts([x or "" for x in texts]) for x in find_all(crf.value, part))
            yield pd.DataFrame({"file_id": b["file_id"], "content": [None if x is None else mask(x, spans) for x, spans in zip(texts, found)]})

    return files.select("file_id", "content").mapInPandas(run, f"file_id {kind}, content string")
