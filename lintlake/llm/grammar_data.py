"""Tokens and productions of JSON and YAML."""

from __future__ import annotations

import re
from functools import lru_cache

from lintlake.llm.grammar import Pairs, Roles

_JSON = re.compile(
    r"(?P<space>[ \t\n\r]+)|(?P<string>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*+\")"
    r"|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-]))|(?P<literal>(?:true|false|null)(?!\w))|(?P<op>[{}\[\],:])"
)
BRACE = Roles(0xE100, ["value"])
SQUARE = Roles(0xE200, ["value"])


def lex_json(text: str) -> tuple[str, str]:
    out, at = [], 0
    stack: list[str] = []
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            return "".join(out), f"character {text[at]!r}"
        at = m.end()
        kind = m.lastgroup
        if kind == "space":
            continue
        k = m.group() if kind == "op" else {"string": "s", "number": "0", "literal": "l"}[kind]
        if k in "{[" :
            stack.append(k)
        elif k in "}]" and (not stack or stack.pop() + k not in ("{}", "[]")):
            return "".join(out), "bracket without its partner"
        out.append(k)
    return "".join(out), "bracket is not closed" if stack else ""


class JsonGrammar:
    def __init__(self):
        value = f"[s0l{BRACE.char(1)}{SQUARE.char(1)}]"
        self.source = {"{value": f"(?:s:{value}(?:,s:{value})*)?", "[value": f"(?:{value}(?:,{value})*)?", "top": value}
        self.rx = {k: re.compile(v) for k, v in self.source.items()}
        self.fits = lru_cache(100_000)(lambda role, text: self.rx[role].fullmatch(text) is not None)

    def fault(self, tokens: str) -> str:
        stack: list[tuple[str, list[str]]] = []
        here: list[str] = []
        for ch in tokens:
            if ch in "{[":
                stack.append((ch, here))
                here = []
            elif ch in "}]":
                kind, outer = stack.pop()
                if not self.fits(kind + "value", "".join(here)):
                    return f"contents of {kind}"
                here = outer
                here.append((BRACE if kind == "{" else SQUARE).char(1))
            else:
                here.append(ch)
        return "" if self.fits("top", "".join(here)) else "value"

    def pairs(self) -> set[tuple[str, str]]:
        wrap = {BRACE.char(0): ("{", "}"), SQUARE.char(0): ("[", "]")}
        expand = {BRACE.char(0): [self.source["{value"]], SQUARE.char(0): [self.source["[value"]]}
        return Pairs(expand, wrap, [BRACE, SQUARE]).derive([self.source["top"]])


# YAML tokens, one line of text being one or more of them: indentation is written as a number of ">" after a line end.
#   - ? :  indicators of entries, keys and values     s quoted scalar    t plain scalar    b block scalar
#   [ ] { } , flow collections, f and g as wholes    T S scalars over several lines    * alias    & anchor or tag    = document start or end    % directive
_PLAIN_STOP = re.compile(r":(?=[ \t]|$)|[ \t]#")
_QUOTED = re.compile(r"'(?:[^']|'')*+'|\"(?:[^\"\\]|\\[\s\S])*+\"")
_BLOCK = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:(?<=[ \t])#.*)?$")
_PROPERTY = re.compile(r"(?:&[^\s\[\]{},]+|!(?:<[^>\s]*>|[^\s\[\]{},]*))(?=[ \t]|$)")
_ALIAS = re.compile(r"\*[^\s\[\]{},]+(?=[ \t]|$|,)")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?![0abt\tnvfre \"/\\N_LP\n\r]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})")


_FLOW_SPACE = re.compile(r"(?:[ \t\n]+|#[^\n]*)+")
_FLOW_CHAR = r"(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|\Z)|(?<=\S)#)"
_FLOW_PLAIN = re.compile(r"(?![-?:](?:[\s,\[\]{}]|\Z))[^\s,\[\]{}#&*!|>'\"%@`]" + _FLOW_CHAR + r"*+(?:\s++(?!#)" + _FLOW_CHAR + "++)*+")
_FLOW_PROPERTY = re.compile(r"(?:&[^\s\[\]{},]+|!(?:<[^>\s]*>|[^\s\[\]{},]*))(?=[\s,\[\]{}]|\Z)")


def _flow(text: str, at: int) -> tuple[str, int, str]:
    """(tokens, place after it, error or "") of the flow collection that starts at ``at``.

    T and S are scalars over several lines; other classes are as in a block.
    """
    out: list[str] = []
    stack: list[str] = []
    n = len(text)
    while at < n:
        m = _FLOW_SPACE.match(text, at)
        if m:
            if re.search(r"\n(?:---|\.\.\.)(?:\s|\Z)", text[at : m.end() + 4]):
                return "", at, "document mark in a flow collection"
            at = m.end()
            continue
        ch = text[at]
        if ch in "[{":
            stack.append(ch)
            out.append(ch)
            at += 1
        elif ch in "]}":
            if stack.pop() + ch not in ("[]", "{}"):
                return "", at, "bracket without its partner"
            out.append(ch)
            at += 1
            if not stack:
                return "".join(out), at, ""
        elif ch == ",":
            out.append(ch)
            at += 1
        elif ch in "'\"":
            m = _QUOTED.match(text, at)
            if not m:
                return "", at, "quoted scalar is not closed"
            if ch == '"' and "\\" in m.group() and _BAD_ESCAPE.search(m.group()[1:-1]):
                return "", at, "escape in a quoted scalar"
            out.append("S" if "\n" in m.group() else "s")
            at = m.end()
        elif ch == ":" and (out[-1] in "sS]}" and text[at - 1] in "'\"]}" or at + 1 == n or text[at + 1] in " \t\n,[]{}"):
            out.append(":")
            at += 1
        elif ch == "?" and (at + 1 == n or text[at + 1] in " \t\n,[]{}"):
            out.append("?")
            at += 1
        elif ch in "&!":
            m = _FLOW_PROPERTY.match(text, at)
            if not m:
                return "", at, "anchor or tag"
            out.append("&")
            at = m.end()
        elif ch == "*":
            m = re.compile(r"\*[^\s\[\]{},]+").match(text, at)
            if not m:
                return "", at, "alias"
            out.append("*")
            at = m.end()
        else:
            m = _FLOW_PLAIN.match(text, at)
            if not m:
                return "", at, f"character {ch!r} starts no scalar"
            out.append("T" if "\n" in m.group() else "t")
            at = m.end()
    return "", at, "flow collection is not closed"


def lex_yaml(text: str) -> tuple[str, str]:
    """(tokens, error or ""). Scalars over several lines are one token."""
    if text[:1] == "﻿":
        text = text[1:]
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    bad = re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x80-\x84\x86-\x9f\ufffe\uffff\ud800-\udfff]", text)
    if bad:
        return "", f"character {bad.group()!r}"
    out: list[str] = []
    at, n = 0, len(text)
    fresh = True
    indent = 0
    while at < n:
        if fresh:
            m = re.compile(r" *").match(text, at)
            end = text.find("\n", at)
            end = n if end < 0 else end
            line = text[at:end]
            body = line.strip(" \t")
            if not body or body[0] == "#":
                at = end + 1
                continue
            indent = len(m.group())
            if re.match(r"(?:---|\.\.\.)(?:[ \t]|$)", line):
                out.append("\n=")
                at += 3
                fresh = False
                continue
            if line[0] == "%" and (not out or out[-1] == "\n="):
                out.append("\n%")
                at = end + 1
                continue
            if body and line[indent : indent + 1] == "\t":
                return "".join(out), "tab in the indentation"
            out.append("\n" + ">" * indent)
            at += indent
            fresh = False
            continue
        ch = text[at]
        if ch == "\n":
            fresh = True
            at += 1
            continue
        if ch in " \t":
            at += 1
            continue
        end = text.find("\n", at)
        end = n if end < 0 else end
        rest = text[at:end]
        before = text[at - 1] if at else "\n"
        if ch == "#" and before in " \t\n":
            at = end
            continue
        if ch in "-?:" and (len(rest) == 1 or rest[1] in " \t"):
            out.append(ch)
            if ch != ":":
                out.append("<" + ">" * _column(text, at, rest))
            at += 1
            continue
        if ch in "|>":
            if not _BLOCK.match(rest):
                return "".join(out), "header of a block scalar"
            out.append("b")
            at = end + 1
            # lines that are blank or deeper than the line's own block
            level = None
            base = _parent_indent(out)
            while at < n:
                e = text.find("\n", at)
                e = n if e < 0 else e
                l = text[at:e]
                if l.strip(" "):
                    k = len(l) - len(l.lstrip(" "))
                    if level is None:
                        if k <= base:
                            break
                        level = k
                    elif k < level:
                        break
                at = e + 1
            fresh = True
            continue
        if ch in "'\"":
            m = _QUOTED.match(text, at)
            if not m:
                return "".join(out), "quoted scalar is not closed"
            if ch == '"' and "\\" in m.group() and _BAD_ESCAPE.search(m.group()[1:-1]):
                return "".join(out), "escape in a quoted scalar"
            if re.search(r"\n(?:---|\.\.\.)(?:\s|$)", m.group()):
                return "".join(out), "document mark in a quoted scalar"
            out.append("S" if "\n" in m.group() else "s")
            at = m.end()
            if at < n and text[at] not in " \t\n:" :
                return "".join(out), "text after a quoted scalar"
            if at < n and text[at] == ":" and at + 1 < n and text[at + 1] not in " \t\n":
                return "".join(out), "text after a quoted scalar"
            continue
        if ch in "[{":
            inside, at, error = _flow(text, at)
            if error:
                return "".join(out), error
            out.append(inside)
            continue
        if ch in "&!" and (m := _PROPERTY.match(text, at, end)):
            out.append("&")
            at = m.end()
            continue
        if ch == "*":
            m = _ALIAS.match(text, at, end)
            if not m:
                return "".join(out), "alias"
            out.append("*")
            at = m.end()
            continue
        if ch in "@`%,]}&":
            return "".join(out), f"character {ch!r} starts no scalar"
        m = _PLAIN_STOP.search(text, at, end)
        stop = m.start() if m else end
        out.append("t")
        at = stop
        if m and m.group()[0] != ":":
            out.append("#")  # a comment ends a plain scalar
    return "".join(out), ""


def _column(text: str, at: int, rest: str) -> int:
    """Column of what follows an entry's dash on its line, or of the dash plus one."""
    start = text.rfind("\n", 0, at) + 1
    m = re.compile(r"[-?:][ \t]+(?=[^\s#])").match(rest)
    return at - start + (m.end() if m else 1)


def _parent_indent(out: list[str]) -> int:
    """Indentation that a block scalar's lines must exceed: that of the block that holds it."""
    for k in range(len(out) - 1, -1, -1):
        x = out[k]
        if x[0] == "<":
            after = "".join(out[k + 1 :])
            return len(x) - 1 if ":" in after else len(x) - 2 if len(x) > 1 else 0
        if x[0] == "\n":
            return -1 if x[1:2] == "=" else len(x) - 1 if ":" in "".join(out[k + 1 :]) else len(x) - 2
    return -1


class YamlGrammar:
    """Productions over lines of tokens; the stack holds the open blocks as (indentation, kind, what may come)."""

    line = re.compile(r"(?P<entries>(?:[-?]<>*)*)(?P<props>&*)(?P<node>[sStf*]?)(?P<c1>#?)(?P<key>:?)(?P<more>.*)", re.S)
    value = re.compile(r"&{0,2}(?:[sStf*b]#?|-<>*.*)?")
    #: The order of tokens within a line, without columns.
    tokens = "(?:=?%?(?:[-?])*:?(?:[-?])*&{0,2}(?:[sStfg*]#?|b)?(?::&{0,2}(?:[sStfg*]#?|b|-)?)?)"
    #: Contents of flow collections: nodes and pairs with commas between; the key of a pair in a list stands on one line.
    _node = r"(?:&{0,2}[sStTfg]|\*|&{1,2})"
    _pair = rf"(?:\?{_node}?(?::{_node}?)?|:{_node}?"
    _listed = [_pair + rf"|{_node}|(?:&{{0,2}}[stfg]|\*|&{{1,2}}):{_node}?)", _pair + rf"|{_node}(?::{_node}?)?)"]
    flow = {k: f"(?:{x}(?:,{x})*,?)?" for k, x in zip("[{", _listed)}
    flow_rx = {k: re.compile(x) for k, x in flow.items()}

    def pairs(self) -> set[tuple[str, str]]:
        return Pairs({"f": [self.flow["["]], "g": [self.flow["{"]]}, {"f": ("[", "]"), "g": ("{", "}")}).derive([self.tokens])

    def _flat(self, tokens: str) -> str | None:
        """Flow collections as one class each, from the inside out; None if the contents of one fit no production."""
        stack: list[tuple[str, list[str]]] = []
        here: list[str] = []
        for ch in tokens:
            if ch in "[{":
                stack.append((ch, here))
                here = []
            elif ch in "]}":
                kind, outer = stack.pop()
                if not self.flow_rx[kind].fullmatch("".join(here)):
                    return None
                here = outer
                here.append("f" if kind == "[" or not stack else "g")
            else:
                here.append(ch)
        return "".join(here)

    def fault(self, tokens: str) -> str:
        tokens = self._flat(tokens)
        if tokens is None:
            return "contents of a flow collection"
        stack: list[list] = []  # [indent, kind, waiting for a value, after a "?"]
        text_open = -1  # a plain scalar that deeper lines may continue: they must be deeper than this
        done = False  # the document's root is complete
        for raw in tokens.split("\n"):
            if not raw:
                continue
            if raw[0] == "=":
                stack, text_open, done = [], -1, False
                raw = raw[1:]
                if not raw:
                    continue
                indent = -1
            elif raw[0] == "%":
                continue
            else:
                indent = len(raw) - len(raw.lstrip(">"))
                raw = raw[indent:]
            m = self.line.fullmatch(raw)
            entries, key, node = m["entries"], m["key"], m["node"]
            # a plain scalar goes on over deeper lines
            if text_open > -2 and text_open != -1 and raw[:1] in "tsSf*&-?:" and indent >= text_open and not done:
                if ":" in raw and (key or ":" in m["more"]):
                    return "mapping inside a plain scalar"
                if raw[-1:] == "#":
                    text_open = -1
                continue
            text_open = -1
            while stack and stack[-1][0] > indent:
                stack.pop()
            at = indent
            if raw[:1] == ":" and not (stack and stack[-1][0] == at and stack[-1][3]):
                return "value without a key"
            levels = re.findall(r"([-?])<(>*)", entries)
            for ch, pad in levels:
                kind = "seq" if ch == "-" else "map"
                fault = self._open(stack, at, kind)
                if fault:
                    return fault
                stack[-1][2:] = [True, ch == "?"]
                at = len(pad)
            more = m["more"]
            if key:
                if node in ("S",):
                    return "key over several lines"
                if m["c1"]:
                    return "comment inside a key"
                if at < 0:
                    return "mapping on the line of a document mark"
                fault = self._open(stack, at, "map")
                if fault:
                    return fault
                stack[-1][2:] = [True, False]
                if not self.value.fullmatch(more):
                    return "mapping values"
                if more.startswith("-"):
                    return "sequence on the line of a key"
                if more.lstrip("&"):
                    stack[-1][2] = False
                    if more.lstrip("&") == "t":
                        text_open = at + 1
                continue
            if not (node or m["props"] or more):
                continue  # an entry whose value follows or is null
            if more.lstrip("#") and more != "b":
                return "text after a node"
            # a scalar or collection alone: the value that a key or entry waits for, or the root
            if levels:
                stack[-1][2] = False
                if node == "t" and not m["c1"]:
                    text_open = stack[-1][0] + 1
                continue
            if m["props"] and not node and not more:
                if stack and not stack[-1][2]:
                    return "properties without a node"
                continue
            top = stack[-1] if stack else None
            if top is None:
                if done:
                    return "second root"
                if node == "t" and not m["c1"]:
                    text_open = 0
                    stack.append([-2, "root", False, False])
                    continue
                stack.append([-2, "root", False, False])
            elif top[2] and indent > top[0]:
                top[2] = False
                if node == "t" and not m["c1"]:
                    text_open = top[0] + 1
            else:
                return "scalar where a key is expected"
        return ""

    @staticmethod
    def _open(stack: list[list], at: int, kind: str) -> str:
        """Continue the block at this indentation or open one where a value is awaited."""
        if stack and stack[-1][0] == at and stack[-1][1] == kind:
            return ""
        if stack and stack[-1][0] == at and stack[-1][1] == "seq" and kind == "map" and len(stack) > 1 and stack[-2][0] == at:
            stack.pop()  # a sequence at the indentation of its key ends
            return ""
        if not stack:
            stack.append([at, kind, False, False])
            return ""
        top = stack[-1]
        if top[1] == "root":
            return "second root"
        if top[2] and (at > top[0] or kind == "seq" and top[1] == "map" and at == top[0]):
            top[2] = False
            stack.append([at, kind, False, False])
            return ""
        return "indentation"
