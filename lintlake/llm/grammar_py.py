"""Tokens and productions of Python 3: logical lines, their suites and clauses."""

from __future__ import annotations

import re
from functools import lru_cache

from lintlake.llm.grammar import NL, Pairs, Roles

_WORDS = {
    "def": "F", "class": "K", "if": "I", "elif": "J", "else": "E", "for": "O", "while": "W", "try": "Y", "except": "H",
    "finally": "L", "with": "w", "return": "R", "raise": "T", "import": "M", "from": "φ", "as": "δ", "pass": "B",
    "break": "B", "continue": "B", "global": "G", "nonlocal": "G", "del": "D", "assert": "S", "lambda": "Λ", "yield": "υ",
    "await": "ω", "async": "α", "not": "N", "and": "o", "or": "o", "in": "n", "is": "ι", "None": "l", "True": "l", "False": "l",
    "match": "μ", "case": "κ", "type": "τ",
}
IDS = "iμκτ"
INDENT, DEDENT = "⇥", "⇤"
_AUG = set("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_TOKEN = re.compile(
    r"(?P<space>[ \t\f]+|\\\r?\n)|(?P<comment>#[^\n\r]*)|(?P<line>\r\n|\r|\n)"
    r"|(?P<long>(?:[rRbBuUfFtT]{0,3})(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*+'''))"
    r"|(?P<short>(?:[rRbBuUfFtT]{0,3})(?:\"(?:[^\\\"\n\r]|\\(?:\r\n|[\s\S]))*+\"|'(?:[^\\'\n\r]|\\(?:\r\n|[\s\S]))*+'))"
    r"|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|>>|<<|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:.;=])"
)
_FORMATTED = re.compile(r"(?:([rR])[fFtT]|[fFtT]([rR]?))(\"\"\"|\'\'\'|\"|\')")
_CONVERSION = re.compile(r"![ \t]*[rsa]\s*(?=[:}])")
_PREFIXES = {"", "r", "b", "u", "f", "t", "rb", "br", "fr", "rf", "tr", "rt"}


def _literal(text: str, at: int, quote: str, raw: bool, spec: bool) -> tuple[int, str]:
    """Place after the next literal part of a formatted string, and what ends it: { a field, } the field of a
    format specification, the quote, or "" where the string is broken."""
    n = len(text)
    while at < n:
        ch = text[at]
        if ch == "\\":
            if not raw and text.startswith("N{", at + 1):
                at = text.find("}", at) + 1
                if not at:
                    return n, ""
            else:
                at += 1 if text[at + 1 : at + 2] in ("{", "}") else 2
        elif text.startswith(quote, at):
            return at + len(quote), "" if spec else quote
        elif ch in "{}":
            if not spec and text[at + 1 : at + 2] == ch:
                at += 2
            else:
                return at + 1, ch if ch == "{" or spec else ""
        elif ch in "\r\n" and len(quote) == 1:
            return at, ""
        else:
            at += 1
    return n, ""


def lex(text: str) -> tuple[str, str]:
    """(token classes, error or ""): line ends outside brackets, and a class for each step of indentation."""
    out: list[str] = []
    stack: list[str] = []
    fields: list[tuple[str, bool, bool]] = []  # for each open field of a formatted string: quote, raw, in a specification
    levels = [""]
    at, n, start = 0, len(text), True
    if text[:1] == "﻿":
        at = 1
    if "\0" in text:
        return "", "null character"
    while at < n:
        if start and not stack:
            m = re.compile(r"[ \t\f]*").match(text, at)
            pad = m.group().rpartition("\f")[2]
            at = m.end()
            if at >= n or text[at] in "#\r\n":
                pass
            elif pad != levels[-1]:
                if pad.startswith(levels[-1]):
                    levels.append(pad)
                    out.append(INDENT)
                else:
                    while len(levels) > 1 and levels[-1] != pad:
                        levels.pop()
                        out.append(DEDENT)
                    if levels[-1] != pad:
                        return "".join(out), "indentation"
            start = False
            continue
        part = None  # formatted string whose literal text goes on at this place
        m = _FORMATTED.match(text, at)
        if m:
            out.append("s")
            at, part = m.end(), (m.group(3), bool(m.group(1) or m.group(2)), False)
        elif stack and stack[-1] == "⟨" and text[at] in "}:!=":
            if text[at] == "}":
                stack.pop()
                out.append("⟩")
                at, part = at + 1, fields.pop()
            elif text[at] == ":":
                out.append(":")
                at, part = at + 1, (*fields[-1][:2], True)
            elif m := _CONVERSION.match(text, at) or re.compile(r"=\s*(?=[!:}](?!=))").match(text, at):
                out.append(text[at])
                at = m.end()
                continue
        while part:
            at, what = _literal(text, at, *part)
            if not what:
                return "".join(out), "formatted string is not closed"
            if what == "{":
                out.append("⟨")
                stack.append("⟨")
                fields.append(part)
                break
            if what != "}":
                break
            stack.pop()
            out.append("⟩")
            part = fields.pop()
        if part:
            continue
        m = _TOKEN.match(text, at)
        if not m:
            return "".join(out), f"character {text[at]!r}"
        kind, s = m.lastgroup, m.group()
        at = m.end()
        if kind in ("space", "comment"):
            continue
        if kind == "line":
            start = not stack
            if not stack and out and out[-1] not in (NL, INDENT, DEDENT):
                out.append(NL)
            continue
        if kind == "name":
            out.append(_WORDS.get(s, "i") if out[-1:] != ["."] or s in _WORDS and _WORDS[s] not in IDS else "i")
        elif kind == "number":
            if at < n and (text[at].isalnum() or text[at] == "_") and not re.match(r"(?:and|else|for|if|in|is|or|not)\b", text[at : at + 5]):
                return "".join(out), "number runs into a name"
            if re.fullmatch(r"0[\d_]*[1-9][\d_]*", s):
                return "".join(out), "leading zero"
            out.append("0")
        elif kind in ("long", "short"):
            if re.match(r"\w*", s).group().lower() not in _PREFIXES:
                return "".join(out), "string prefix"
            if kind == "short" and s[-2:] in ('""', "''") and len(s.lstrip("rRbBuUfFtT")) == 2 and text[at : at + 1] == s[-1]:
                return "".join(out), "string is not closed"
            out.append("s")
        else:
            if s in "([{":
                stack.append(s)
            elif s in ")]}":
                if not stack or stack.pop() + s not in ("()", "[]", "{}"):
                    return "".join(out), "bracket without its partner"
            if s in _AUG:
                k = "A"
            elif s in "+-":
                k = "+"
            elif s == "**":
                k = "p"
            elif s == ":=":
                k = "V"
            elif s == "->":
                k = "a"
            elif s == "...":
                k = "l"
            elif s in "()[]{},:.;=*@/~":
                k = s
            else:
                k = "o"
            out.append(k)
    if stack:
        return "".join(out), "bracket is not closed"
    if out and out[-1] not in (NL, INDENT, DEDENT):
        out.append(NL)
    out += [DEDENT] * (len(levels) - 1)
    return "".join(out), ""


PAREN = Roles(0xE000, ["args", "params", "value", "names", "target"])
BRACE = Roles(0xE100, ["value"])
SQUARE = Roles(0xE200, ["value", "index", "target"])
COND, LAMBDA, FIELD = chr(0xE400), chr(0xE401), chr(0xE402)


def _c(*cs: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[" else c for c in "".join(cs)) + "]"


def productions() -> dict[str, str]:
    p, b, s = PAREN.having, BRACE.having, SQUARE.having
    name = _c(IDS)
    primary = f"(?:{name}|0|(?:s{FIELD}*+)++|l|{_c(p('value'))}|{_c(b('value'))}|{_c(s('value'))})"
    suffix = f"(?:\\.{name}|{_c(p('args'))}|{_c(s('index'))})"
    u = f"(?:[+~Nω{LAMBDA}]*{primary}{suffix}*+)"
    bin_ = f"(?:[op+*/@n{COND}]|Nn|ιN?)"
    a = f"(?>{u}(?:{bin_}{u})*+)"
    named = f"(?>{name}V{a}|{a})"
    star = f"(?:\\*{a}|{named})"
    tests = f"(?:{star}(?:,{star})*,?)"
    target1 = f"(?>\\*?(?:{primary}{suffix}*(?:\\.{name}|{_c(s('index'))})|{name}|{_c(p('target'))}|{_c(s('target'))}))"
    targets = f"(?:{target1}(?:,{target1})*,?)"
    comp = f"(?:α?O{targets}n{a}(?:I{named})*)"
    arg = f"(?:{name}={a}|\\*{a}|p{a}|{named}{comp}*)"
    param = f"(?:{name}(?::{star})?(?:={a})?|\\*(?:{name}(?::{star})?)?|p{name}(?::{a})?|/)"
    slice_ = f"(?:{named}?:{named}?(?::{named}?)?|{star})"
    yield_ = f"υ(?:φ{a}|{tests})?"
    value = f"(?:{yield_}|{tests})"
    dotted = f"{name}(?:\\.{name})*"
    as_ = f"(?:δ{name})?"
    names = f"{name}{as_}(?:,{name}{as_})*,?"
    simple = (
        f"(?:{value}|{targets}(?:=(?:{targets}))*={value}|{targets}={value}|{target1}A{value}|{target1}:{a}(?:={value})?|R{tests}?|T(?:{a}(?:φ{a})?)?|B"
        f"|G{name}(?:,{name})*|D{targets}|S{named}(?:,{a})?|M{dotted}{as_}(?:,{dotted}{as_})*|φ(?:[.l]*{dotted}|[.l]+)M(?:\\*|{names}|{_c(p('names'))})|τ{name}{_c(s('index'))}?={a})"
    )
    line = f"{simple}(?:;{simple})*;?"
    piece = f"(?:\\*{name}|{named})"
    pattern = f"(?:{piece}(?:δ{name})?(?:,{piece}(?:δ{name})?)*,?)"
    item = f"{a}(?:δ{target1})?"
    header = (
        f"(?:α?F{name}{_c(s('index'))}?{_c(p('params'))}(?:a{tests})?|K{name}{_c(s('index'))}?{_c(p('args'))}?|[IJW]{named}|E|Y|L|H\\*?(?:{tests}(?:δ{name})?)?"
        f"|α?O{targets}n{tests}|α?w{item}(?:,{item})*|μ{tests}|κ{pattern}(?:I{named})?)"
    )
    return {
        "(args": f"(?:{arg}(?:,{arg})*,?)?", "(params": f"(?:{param}(?:,{param})*,?)?", "(value": f"(?:{yield_}|{tests}|{named}{comp}+)?",
        "(names": names, "(target": f"{targets}?",
        "{value": f"(?:(?:{named}:{a}|p{a})(?:,(?:{named}:{a}|p{a}))*,?|{tests}|{named}(?::{a})?{comp}+)?",
        "[value": f"(?:{tests}|{named}{comp}+)?", "[index": f"{slice_}(?:,{slice_})*,?", "[target": f"{targets}?",
        "⟨": f"{value}=?!?(?::{FIELD}*)?", "cond": f"I{a}E", "lambda": f"Λ(?:{param}(?:,{param})*,?)?:",
        "simple": line, "decorator": f"@{named}", "header": f"{header}:", "inline": f"{header}:{line}",
    }


class Grammar:
    def __init__(self):
        self.source = productions()
        self.rx = {k: re.compile(v) for k, v in self.source.items()}
        self.group = lru_cache(200_000)(self._group)
        self.line = lru_cache(200_000)(self._line)

    def _flat(self, content: str) -> str:
        while True:
            new = content
            if "Λ" in new:
                new = self.rx["lambda"].sub(LAMBDA, new)
            if "I" in new:
                new = self.rx["cond"].sub(COND, new)
            if new == content:
                return new
            content = new

    def _group(self, kind: str, content: str) -> str:
        flat = self._flat(content)
        if kind == "⟨":
            return FIELD if self.rx["⟨"].fullmatch(flat) else ""
        roles = {"(": PAREN, "{": BRACE, "[": SQUARE}[kind]
        mask = sum(1 << k for k, name in enumerate(roles.names) if self.rx[kind + name].fullmatch(flat))
        return roles.char(mask) if mask else ""

    def _line(self, content: str) -> str:
        """Kind of a logical line: ``:`` and ``;`` are headers with and without a suite below, then the clause."""
        if self.rx["simple"].fullmatch(content):
            return "s"
        if self.rx["decorator"].fullmatch(content):
            return "@"
        flat = self._flat(content)
        for kind, mark in (("simple", "s"), ("header", ":"), ("inline", ";")):
            if self.rx[kind].fullmatch(flat):
                return "s" if mark == "s" else mark + flat.lstrip("α")[0]
        return ""

    def fault(self, tokens: str) -> str:
        stack: list[tuple[str, list[str]]] = []
        here: list[str] = []
        # a frame for each level of indentation: clause before, whether a suite must follow
        clause, need, deco = [""], False, False
        for ch in tokens:
            if ch in "([{⟨":
                stack.append((ch, here))
                here = []
            elif ch in ")]}⟩":
                kind, outer = stack.pop()
                got = self.group(kind, "".join(here))
                if not got:
                    return f"contents of {kind}"
                here = outer
                here.append(got)
            elif ch == INDENT:
                if not need:
                    return "indentation without a header"
                need = False
                clause.append("")
            elif ch == DEDENT:
                if need or deco or clause[-1] == "Y":
                    return "suite is missing"
                clause.pop()
            elif ch == NL and not stack:
                if need:
                    return "suite is missing"
                kind = self.line("".join(here))
                here = []
                if not kind:
                    return "statement"
                c = kind[1:]
                if deco and kind[0] != "@" and c not in ("F", "K"):
                    return "decorator without a definition"
                deco = kind[0] == "@"
                last = clause[-1]
                if c in ("J", "E", "H", "L"):
                    fits = {"J": last in ("I", "J"), "E": last in ("I", "J", "O", "W", "H"), "H": last in ("Y", "H"), "L": last in ("Y", "H", "YE")}[c]
                    if not fits:
                        return "clause without its statement"
                    clause[-1] = "YE" if c == "E" and last == "H" else c if c != "E" else "E"
                else:
                    if last[:1] == "Y" and last != "YE":
                        return "try without a handler"
                    clause[-1] = c
                need = kind[0] == ":"
            else:
                here.append(ch)
        if need or deco or clause[-1] == "Y":
            return "suite is missing"
        return ""

    def pairs(self) -> set[tuple[str, str]]:
        kinds = (("(", ")", PAREN), ("{", "}", BRACE), ("[", "]", SQUARE))
        wrap = {r.char(0): (o, c) for o, c, r in kinds}
        expand = {r.char(0): [self.source[o + n] for n in r.names] for o, c, r in kinds}
        wrap[FIELD], expand[FIELD] = ("⟨", "⟩"), [self.source["⟨"]]
        expand |= {COND: [self.source["cond"]], LAMBDA: [self.source["lambda"]]}
        return Pairs(expand, wrap, [PAREN, BRACE, SQUARE]).derive([self.source[x] for x in ("simple", "decorator", "header", "inline")])


@lru_cache(1)
def grammar() -> Grammar:
    return Grammar()
