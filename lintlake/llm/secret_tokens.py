"""Lexical tokens of source code and settings for the credential labeller, and their features.

A token is a name, a piece of a string literal between white space, a piece of a URL inside a literal (user, password,
host, parameter, value), a word of a comment, a value of a settings line, or a whole PEM block. Quotes, brackets and
operators are no tokens; they are features of the token after them. Windows of tokens around every value that could be
a credential are labelled; a file has no other tokens that the labeller could mark.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

BITS = 16

_PEM = r"-----BEGIN (?P<what>[A-Z0-9 ]+)-----[\s\S]*?-----END (?P=what)-----"
_TOKEN = re.compile(
    rf"[ \t\f\v]*+(?:(?P<pem>{_PEM})"
    r"|(?P<line>\r\n?|\n)"
    r"|(?P<slash>/\*|\*/|//(?=[^\n]*)|(?<![\w&])#(?=[ \t!#]))"
    r"|(?P<quote>[\"'`])"
    r"|(?P<url>[A-Za-z][A-Za-z0-9+.-]*://)"
    r"|(?P<word>[^\s\"'`,;(){}\[\]<>=:|]+(?:\|\d+)?)"
    r"|(?P<punct>[=:,;(){}\[\]<>|])"
    r"|(?P<space>[\s\S]|\Z))"
)
_URL_PART = re.compile(r"[^\s\"'`/?#&=:@<>\\]+|[/?#&=:@]")
_VALUE = re.compile(r"[^&]+|&")
_SUB = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Token(NamedTuple):
    start: int
    end: int
    text: str
    kind: str  # name, piece, user, pass, host, path, param, value, note, pem
    quote: str
    before: str  # the last two punctuation characters before it
    alone: bool  # nothing else stands in its literal


#: A value shorter than this is no credential.
SHORTEST = 6
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}", re.I)
_KEY_40 = re.compile(r"(?=.*\d)(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]{40}")
_PADDING = re.compile(r"={1,2}(?=[\s\"'`,;)}\]]|$)")
_PLAIN = re.compile(r"[a-z]+|[A-Z]?[a-z]+|/[\w{}/:.$-]*|[\d.]+|[A-Za-z_$][A-Za-z_$.]*\d{0,2}")


@lru_cache(200_000)
def may_be_secret(text: str) -> bool:
    """Whether the labeller looks at a value: all but short ones, plain words and names, paths and numbers."""
    if len(text) < SHORTEST:
        return False
    if _PLAIN.fullmatch(text) is None or _KEY_40.fullmatch(text) or any(rx.fullmatch(text) for rx in _FORMATS.values()):
        return True
    return len(text) >= 8 and text[0] != "/" and (_CONSONANTS.search(text) is not None or _mixed(text))


def _mixed(text: str) -> bool:
    """Letters in a case pattern that no word or camel-case name has."""
    parts = _SUB.findall(text)
    return text.isalnum() and not text.islower() and not text.isupper() and len(parts) >= 3 and max(map(len, parts)) <= 5


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    before = ""
    quote, literal_from = "", 0
    comment = ""
    at, n = 0, len(text)

    def add(s: int, e: int, kind: str) -> None:
        nonlocal before
        out.append(Token(s, e, text[s:e], kind, quote, before[-2:], False))
        before = ""

    while at < n:
        m = _TOKEN.match(text, at)
        kind = m.lastgroup
        if kind == "what" or kind == "pem":
            kind = "pem"
        s, e = m.span(kind)
        at = e
        if kind == "pem":
            add(s, e, "pem")
        elif kind == "line":
            if comment == "line":
                comment = ""
            if quote and quote != "`":
                quote = ""
            before = "\n"
        elif kind == "slash":
            t = m.group(kind)
            if quote:
                before += t[-1]
            elif t == "/*":
                comment = "block"
            elif t == "*/":
                comment = ""
            else:
                comment = comment or "line"
                before = "/"
        elif kind == "quote":
            q = m.group(kind)
            if comment or quote and q != quote:
                before += q
                if not comment:
                    continue
            elif quote:
                if len(out) - literal_from == 1:
                    out[-1] = out[-1]._replace(alone=True)
                quote = ""
                before = "\""
            else:
                quote, literal_from = q, len(out)
        elif kind == "url":
            add(s, e, "scheme")
            at = _url(text, e, out, quote, add)
        elif kind == "word":
            w = m.group(kind)
            if len(w) > 7 and text[e : e + 1] == "=" and (pad := _PADDING.match(text, e)) and (quote or text[pad.end() : pad.end() + 1] not in "\"'` \t" or comment):
                e = at = pad.end()
                w = text[s:e]
            if not quote and w[-1:] in ".," and not may_be_secret(w):
                e -= 1
            add(s, max(e, s + 1), "note" if comment else "piece" if quote else "name")
        elif kind == "punct":
            before += m.group(kind)
        elif not quote and not comment:
            before += m.group(kind)
    return out


def _url(text: str, at: int, out: list[Token], quote: str, add) -> int:
    """Pieces of a URL from after its scheme."""
    end = at
    while end < len(text) and text[end] not in " \t\r\n\"'`<>\\,;)}]" or text[end : end + 1] == "}" and "{" in text[at:end]:
        end += 1
    body = text[at:end]
    stop = re.search(r"[/?#]", re.sub(r"\$\{[^}]*\}|\{\{.*?\}\}", lambda m: "x" * len(m.group()), body))
    authority = body[: stop.start()] if stop else body
    user, mark, _ = authority.rpartition("@")
    if mark:
        name, colon, secret = user.partition(":")
        if name:
            add(at, at + len(name), "user")
        if colon and secret:
            add(at + len(name) + 1, at + len(user), "pass")
        at += len(user) + 1
    kind = "host"
    while at < end:
        m = (_VALUE if kind == "value" else _URL_PART).match(text, at, end)
        if m is None:
            at += 1
            continue
        t, at = m.group(), m.end()
        if len(t) == 1 and t in "/?#&=:@":
            if t == "/" and kind == "host":
                kind = "path"
            elif t in "?&#":
                kind = "param"
            elif t == "=" and kind == "param":
                kind = "value"
        else:
            add(m.start(), at, kind)
    return end


def _bucket(x: float, step: float) -> int:
    return int(x / step)


# Public formats of issued keys; each name is a feature, none decides alone.
FORMATS = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "github_fine_grained_token": r"github_pat_\w{30,}",
    "gitlab_token": r"glpat-[\w-]{18,}",
    "npm_token": r"npm_[A-Za-z0-9]{30,}",
    "slack_token": r"xox[abeoprs]-[\w-]{18,}",
    "sendgrid_key": r"SG\.[\w-]{15,}\.[\w-]{20,}",
    "stripe_live_key": r"[sr]k_live_[A-Za-z0-9]{16,}",
    "google_api_key": r"AIza[\w-]{35}",
    "google_oauth_token": r"ya29\.[\w-]{20,}",
    "twilio_key": r"SK[0-9a-f]{32}",
    "jwt_token": r"eyJ[\w-]{6,}\.[\w-]{6,}\.[\w-]*",
}
_FORMATS = {k: re.compile(v) for k, v in FORMATS.items()}
# Marks of values that stand for a credential without being one.
PLACEHOLDER = re.compile(
    r"example|sample|dummy|changeme|change-me|change_me|placeholder|your[-_ ]|insert|redacted|replace|todo|fixme|(?i:x{6,})|\*{4,}|\.{3}|^<|>$|\$\{|\{\{|%\(|process\.env|os\.environ|getenv|secrets?/|vault/|vault\.|^input/",
    re.I,
)
_CLASSES = (
    ("hex32", re.compile(r"[0-9a-f]{32}")), ("hex40", re.compile(r"[0-9a-f]{40}")), ("hex64", re.compile(r"[0-9a-f]{64}")),
    ("hex", re.compile(r"[0-9a-f]{12,}")), ("uuid", re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)),
    ("hash", re.compile(r"(?:sha\d+|md5)[-:].*")), ("licence", re.compile(r"(?:[A-Z0-9]{4,6}-){2,}[A-Z0-9]{4,6}")),
    ("wordmark", re.compile(r"(?=[A-Za-z]++(?:[!#%&*@+._-][A-Za-z]++)?\d{1,6}\Z)[A-Za-z]{3,}[!#%&*@+._x-][A-Za-z]{3,}\d{1,6}")), ("wordyear", re.compile(r"[A-Za-z]{3,}\d{2,5}[!#%*@x_.]?")),
    ("wordhex", re.compile(r"[a-z]{3,}[._-][0-9a-f]{4,8}")), ("base64", re.compile(r"[A-Za-z0-9+/]{12,}={1,2}")),
    ("base64_40", re.compile(r"[A-Za-z0-9+/]{40}")), ("url64", re.compile(r"[\w-]{24,}")), ("rooted", re.compile(r"/.*")), ("ticket", re.compile(r"[A-Z]{1,6}-\d{1,6}")), ("piped", re.compile(r".*\|\d+")),
    ("slashes", re.compile(r"[\w.-]+(?:/[\w.-]+)+")), ("name", re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")),
    ("number", re.compile(r"[\d.,-]+")), ("lower", re.compile(r"[a-z]+")), ("title", re.compile(r"[A-Z][a-z]+")), ("symbols", re.compile(r"(?=.*[A-Za-z])(?=.*[!#%*$^&+?]).*")),
    ("file", re.compile(r".*\.(?:js|ts|json|css|py|map|png|html|svg)")), ("kebab", re.compile(r"[a-z]+(?:-[a-z]+)+")), ("version", re.compile(r"v?\d+\.\d+.*")),
)


@lru_cache(200_000)
def own_features(text: str) -> tuple[str, ...]:
    """Features of a value's own shape."""
    n = len(text)
    if n > 400:
        if text.startswith("-----BEGIN"):
            return ("long", "pem=" + (re.match(r"-----BEGIN ([A-Z0-9 ]+)", text) or ["", "none"])[1])
        return ("long", *[f"long_class={k}" for k, rx in _CLASSES if rx.fullmatch(text)], *[f"format={k}" for k, rx in _FORMATS.items() if rx.fullmatch(text)])
    if text.startswith("-----BEGIN"):
        return ("pem=" + text[11 : text.index("-----", 11)],) + (("private",) if "PRIVATE" in text[:50] else ("public",))
    classes = [k for k, rx in _CLASSES if rx.fullmatch(text)]
    counts = {}
    for ch in text:
        counts[ch] = counts.get(ch, 0) + 1
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    switches = sum(a.isdigit() != b.isdigit() or a.isupper() and b.islower() for a, b in zip(text, text[1:]))
    out = [f"class={c}" for c in classes] or ["class=none"]
    out += [f"format={k}" for k, rx in _FORMATS.items() if rx.fullmatch(text)]
    if PLACEHOLDER.search(text):
        out += ["placeholder", "class=placeholder"]
    out += [f"length={min(n // 4, 14)}", f"entropy={_bucket(entropy, 0.5)}", f"switches={min(8, _bucket(10 * switches / n, 1))}"]
    if len(counts) <= 2:
        out += ["uniform", "class=uniform"]
    kinds = (any(c.isdigit() for c in text), any(c.isupper() for c in text), any(c.islower() for c in text), any(not c.isalnum() for c in text))
    out.append("kinds=" + "".join("01"[k] for k in kinds))
    return tuple(out)


@lru_cache(100_000)
def name_parts(text: str) -> tuple[str, ...]:
    """Lower-case parts of a camel-case, snake-case or dashed name, and neighbours joined."""
    if len(text) > 60:
        return ()
    parts = [x.lower() for x in _SUB.findall(text) if not x.isdigit()][-4:]
    return tuple(parts) + tuple(a + b for a, b in zip(parts, parts[1:]))


@lru_cache(500_000)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


@lru_cache(200_000)
def _own_slots(text: str, kind: str, quote: str, before: str, alone: bool) -> tuple[int, ...]:
    """Slots of what a token shows by itself."""
    own = own_features(text)
    f = ["bias", f"kind={kind}", f"quote={quote}", f"before={before}", f"kind+quote={kind}{quote}{alone}", *own]
    f += [f"{x}|{kind}" for x in own if x[0] == "c" or x[0] == "f"]
    f += [f"{x}|{quote}{alone}" for x in own if x[0] == "c"]
    if kind in ("name", "piece", "param", "note"):
        f += [f"is={p}" for p in name_parts(text)]
    return tuple(map(_slot, f))


@lru_cache(200_000)
def _main_class(text: str) -> str:
    return next((x for x in own_features(text) if x[0] == "c"), "")


@lru_cache(200_000)
def _prev_slots(text: str, prev_kind: str, opened: str, kind: str, main: str) -> tuple[int, ...]:
    """Slots of the token before, together with how this one is opened and its class."""
    parts = name_parts(text) if prev_kind in ("name", "piece", "param", "note", "user") else (prev_kind,)
    f = [f"prev={x}" for x in parts]
    f += [f"prev={x}&{opened}" for x in parts]
    f += [f"prevend={parts[-1] if len(parts) < 2 else parts[(len(parts) + 1) // 2 - 1]}" if parts else "prevend="]
    f += [f"prevkind={prev_kind}>{kind}"]
    f += [f"prev={x}&{main}" for x in parts]
    return tuple(map(_slot, f))


@lru_cache(100_000)
def _far_slots(text: str) -> tuple[int, ...]:
    return tuple(_slot(f"prev2={x}") for x in name_parts(text))


def features(window: list[Token], k: int) -> tuple[int, ...]:
    """Slots of the features of one token in its window; the parts are looked up by what they depend on."""
    t = window[k]
    out = _own_slots(t.text, t.kind, t.quote, t.before, t.alone)
    if k:
        p = window[k - 1]
        opened = "open" if t.before[-1:] in ("=", ":", ",") else t.before[-1:] or "none"
        out += _prev_slots(p.text, p.kind, opened, t.kind, _main_class(t.text))
        if k > 1:
            out += _far_slots(window[k - 2].text)
    else:
        out += (_slot("first"),)
    if k + 1 < len(window):
        out += (_slot(f"next={window[k + 1].kind}{window[k + 1].before[-1:]}"),)
    return out


# Parts of names that announce a credential, so that even a plain word after them is looked at.
ANNOUNCING = frozenset("password passwd pwd pw pass passphrase secret token apikey credential".split())


def _announced(name: Token, value: Token) -> bool:
    return len(value.text) >= SHORTEST and value.before[-1:] in ("=", ":", ",") and not ANNOUNCING.isdisjoint(name_parts(name.text))


def _has_format(text: str) -> bool:
    return any(rx.fullmatch(text) for rx in _FORMATS.values())


def windows(ts: list[Token], reach: int = 3) -> Iterator[list[Token]]:
    """Runs of tokens from ``reach`` before each value that could be a credential to one after it."""
    last = -1
    run: list[Token] = []
    for k, t in enumerate(ts):
        if t.kind in ("pem", "pass") or t.kind == "host" and _has_format(t.text) or t.kind not in ("scheme", "host") and (may_be_secret(t.text) or k > 0 and _announced(ts[k - 1], t)):
            start = max(last + 1, k - reach)
            if run and start > last + 1:
                yield run
                run = []
            elif not run:
                start = k - reach if k >= reach else 0
            run += ts[start if not run else last + 1 : k + 2]
            last = min(k + 1, len(ts) - 1)
    if run:
        yield run
