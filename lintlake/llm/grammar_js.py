"""Tokens and productions of ECMAScript and TypeScript."""

from __future__ import annotations

import re
from functools import lru_cache

from lintlake.llm.grammar import END, NL, Pairs, Roles, alt, chars, listed, many, opt

# Token classes. Words that are names in some places have classes of their own.
_RESERVED = {
    "var": "V", "const": "C", "function": "F", "class": "K", "if": "I", "else": "E", "for": "O", "while": "W", "do": "D",
    "switch": "S", "case": "c", "default": "d", "break": "B", "continue": "B", "return": "R", "throw": "T", "try": "Y",
    "catch": "H", "finally": "L", "new": "N", "delete": "U", "typeof": "U", "void": "U", "in": "n", "instanceof": "m",
    "this": "l", "null": "l", "true": "l", "false": "l", "super": "l", "import": "M", "export": "X", "extends": "e",
    "enum": "u", "debugger": "b", "with": "w",
}
_CONTEXT = {
    "async": "α", "of": "ο", "get": "γ", "set": "γ", "static": "σ", "await": "ω", "yield": "υ", "let": "λ", "as": "δ",
    "from": "φ",
}
_CONTEXT_TS = {
    "satisfies": "δ", "type": "τ", "interface": "ι", "implements": "ε", "public": "μ", "private": "μ", "protected": "μ",
    "readonly": "μ", "abstract": "μ", "declare": "μ", "override": "μ", "namespace": "ν", "module": "ν", "global": "ν",
    "keyof": "κ", "unique": "κ", "infer": "κ", "asserts": "κ", "is": "π",
}
IDS = "iαογσωυλδφτιεμνκπ"
WORDS = IDS + "".join(sorted(set(_RESERVED.values())))
_ASSIGN = set("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_SINGLE = set("{}()[];,.?:=+-*!~<>|&@")

_SPACE = re.compile(r"[^\S\n\r  ]+|﻿+")
_LINE_END = re.compile(r"[\n\r  ]+")
_COMMENT = re.compile(r"//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*+\*/|\A#![^\n]*")
_NAME = re.compile(r"#?(?:[A-Za-z_$ª-\U0010ffff]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$‌‍]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*")
_NUMBER = re.compile(
    r"(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?"
    r"|(?:\d+(?:_\d+)*)n|(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)"
)
_STRING = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*+\"")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/([A-Za-z]*)")
_PUNCT = re.compile(
    r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|="
    r"|\^=|<<|>>|\*\*|[{}()\[\];,.?:=+\-*/%!~<>|&^@]"
)
#: After these classes a slash starts no regular expression.
_OPERAND_END = set(IDS + "0strlp)]}x")


def lex(text: str, ts: bool = False) -> tuple[str, str]:
    """(token classes with line ends before tokens, error or ""); template substitutions are groups of their own."""
    out: list[str] = []
    stack: list[str] = []  # open brackets; ` for a substitution
    at, n, last = 0, len(text), ""
    parens: list[str] = []  # class before each open parenthesis
    closed = ""  # class before the parenthesis that was closed last
    while at < n:
        ch = text[at]
        if ch in "\n\r  ":
            m = _LINE_END.match(text, at)
            at = m.end()
            if out and out[-1] != NL:
                out.append(NL)
            continue
        m = _SPACE.match(text, at)
        if m:
            at = m.end()
            continue
        if ch == "/" or ch == "#" and at == 0:
            m = _COMMENT.match(text, at)
            if m:
                if "\n" in m.group() and out and out[-1] != NL:
                    out.append(NL)
                at = m.end()
                continue
            if text.startswith("/*", at):
                return "".join(out), "comment is not closed"
        word = ch.isalpha() or ch in "_$#\\"
        if word:
            m = _NAME.match(text, at)
            if not m:
                return "".join(out), f"character {ch!r}"
            w = m.group()
            at = m.end()
            if w[0] == "#":
                k = "p"
            elif last in (".", "q"):
                k = "i"
            else:
                k = _RESERVED.get(w) or _CONTEXT.get(w) or (ts and _CONTEXT_TS.get(w)) or "i"
        elif ch.isdigit() or ch == "." and at + 1 < n and text[at + 1].isdigit():
            m = _NUMBER.match(text, at)
            at = m.end()
            if at < n and (text[at].isalnum() or text[at] in "_$"):
                return "".join(out), "number runs into a name"
            k = "0"
        elif ch in "'\"":
            m = _STRING.match(text, at)
            if not m:
                return "".join(out), "string is not closed"
            if "\\" in m.group() and _BAD_ESCAPE.search(m.group()):
                return "".join(out), "escape in a string"
            at = m.end()
            k = "s"
        elif ch == "`":
            k = "t"
            m = _TEMPLATE.match(text, at + 1)
            at = m.end()
            if at >= n:
                return "".join(out), "template is not closed"
            if text[at] == "`":
                at += 1
            else:
                out += ["t", "⟨"]
                stack.append("`")
                at += 2
                last = "⟨"
                continue
        elif ch == "}" and stack and stack[-1] == "`":
            stack.pop()
            out.append("⟩")
            m = _TEMPLATE.match(text, at + 1)
            at = m.end()
            if at >= n:
                return "".join(out), "template is not closed"
            if text[at] == "`":
                at += 1
                last = "t"
                continue
            out.append("⟨")
            stack.append("`")
            at += 2
            last = "⟨"
            continue
        else:
            if ch == "/" and (last not in _OPERAND_END or last == ")" and closed in set("IWOw")):
                m = _REGEX.match(text, at)
                if m:
                    if len(set(m.group(1))) != len(m.group(1)) or set(m.group(1)) - set("dgimsuvy"):
                        return "".join(out), "flags of a regular expression"
                    at = m.end()
                    out.append("r")
                    last = "r"
                    continue
            m = _PUNCT.match(text, at)
            if not m:
                return "".join(out), f"character {ch!r}"
            p = m.group()
            if ts and p[0] == ">" and p in (">>", ">>>"):
                p = ">"
            at += len(p)
            if p in "([{":
                stack.append(p)
                if p == "(":
                    parens.append(last)
                k = p
            elif p in ")]}":
                if not stack or stack.pop() + p not in ("()", "[]", "{}"):
                    return "".join(out), "bracket without its partner"
                if p == ")":
                    closed = parens.pop() if parens else ""
                k = p
            elif p == "=>":
                k = "a"
            elif p == "...":
                k = "z"
            elif p == "?.":
                k = "q"
            elif p in ("++", "--"):
                k = "x"
            elif p in _ASSIGN:
                k = "A"
            elif p in _SINGLE:
                k = "+" if p in "+-" else "!" if p in "!~" else p
            else:
                k = "o"
        out.append(k)
        last = k
    if stack:
        return "".join(out), "bracket is not closed"
    return "".join(out).rstrip(NL), ""


PAREN = Roles(0xE000, ["type", "for", "params", "args", "expr"])
BRACE = Roles(0xE100, ["module", "enum", "type", "names", "switch", "class", "pattern", "object", "block", "ambient"])
SQUARE = Roles(0xE500, ["signature", "type", "pattern", "index", "array"])
SUBST, FUNC, CLASS, ARROW, COND, GENERIC, ANON, BODY, TYPE_ARROW, TYPE_COND, ELSE, DO = map(chr, range(0xE600, 0xE60C))
BRACES = "".join(map(BRACE.char, range(1 << len(BRACE.names))))
#: Windows of statements, in which an else must have its if.
STATEMENTS = ("top", "{block", "{module", "{switch")


def productions(ts: bool) -> dict[str, str]:
    """Patterns by role; TypeScript's types and declarations only where ``ts``."""
    p, b, s = PAREN.having, BRACE.having, SQUARE.having
    ident, word = chars(IDS), chars(WORDS)
    gen = opt(chars(GENERIC)) if ts else ""

    # types
    fn_type = opt(chars("μ")) + opt(chars("N")) + alt(gen + chars(p("params")) + chars("a"), chars(TYPE_ARROW))
    t_prim = alt(chars(IDS, "lUs0tu"), chars("+") + chars("0"), chars(p("type")), chars(s("type")), chars(b("type")), chars("M") + chars(p("args")))
    t_suffix = alt(chars(".") + word, chars(s('type'))[2:], chars(GENERIC) if ts else "(?!)")
    t_atom = f"(?>{many(fn_type)}{many(chars('κμU'))}{t_prim}{many(t_suffix)})"
    union = f"(?>{opt(chars('|&'))}{t_atom}{many(chars('|&') + t_atom)})"
    type_ = f"(?>{opt(chars('ilκ') + chars('π'))}{union}{many(chars(TYPE_COND) + union)})" if ts else "(?!)"
    typed = opt(chars(":") + type_) if ts else ""
    mods = many(chars("μσ")) if ts else ""

    # expressions
    template = f"\n?t{SUBST}*+"
    primary = alt(
        chars("N") + chars(".") + ident, ident, chars("0srlp"), template, chars(p("expr")), chars(s("array")), chars(b("object")),
        chars(FUNC, CLASS, ANON, BODY), chars("M") + alt("(?=\n?\\.)", chars(p("args"))),
    )
    suffix = alt(
        chars(".") + alt(word, chars("p")), chars("q") + alt(word, chars("p"), chars(p("args")), chars(s("index")), template),
        chars(p("args")), chars(s("index")), template, *(["!(?!=)", chars(GENERIC)] if ts else []),
    )
    unary = alt(chars("!+UxωNυ"), chars(ARROW, TYPE_ARROW) + f"(?!\n?[{BRACES[0]}-{BRACES[-1]}])")  # a brace after an arrow is a block
    u = f"(?>{many(unary)}{primary}(?:{suffix})*+x?)"
    bin_ = alt(chars("o+*<|&=Anm", COND), chars(">") + (opt(">") + opt(">") if ts else ""))
    cast = chars("δ") + alt(chars("C"), type_) if ts else "(?!)"
    yield_alone = chars("υ") + opt(chars("*"))
    a = f"(?>{alt(u, yield_alone)}(?:{bin_}{alt(u, yield_alone)}|{cast})*+)"
    if not ts:
        a = f"(?>{alt(opt(yield_alone) + u, yield_alone)}(?:{bin_}{alt(opt(yield_alone) + u, yield_alone)})*+)"
    expr = f"(?>{a}(?:\n?,{a})*+)"
    key = alt(word, chars("s0p"), chars(s("index")))
    binding = f"{alt(ident, chars(b('pattern')), chars(s('pattern')))}"

    decorator = many(chars("@") + u) if ts else ""
    param = decorator + many(chars("μ")) + opt(chars("z")) + alt(binding, chars("l")) + (opt(chars("?")) if ts else "") + typed + opt(chars("=") + a)
    func = f"{opt(chars('α'))}{chars('F')}{opt(chars('*'))}{ident}{gen}{chars(p('params'))}{typed}{chars(b('block'))}"
    anon = f"{opt(chars('α'))}{chars('F')}{opt(chars('*'))}{gen}{chars(p('params'))}{typed}{chars(b('block'))}"
    heritage = f"(?>{primary}{many(suffix)})"
    impl = opt(chars("ε") + type_ + many(chars(",") + type_)) if ts else ""
    class_ = f"{decorator}{mods}{chars('K')}(?:(?![\n]?[eε]){ident})?{gen}{opt(chars('e') + heritage)}{impl}{chars(b('class'))}"
    arrow = f"{opt(chars('α'))}{alt(ident, gen + chars(p('params')) + typed)}a"
    cond = f"{chars('?')}{a}{chars(':')}"

    # statements
    term = alt(chars(";"), f"(?={NL})", END)
    declarator = binding + (opt("!") if ts else "") + typed
    init = chars("=") + a
    decl = alt(
        chars("Vλ") + declarator + opt(init) + many(chars(",") + declarator + opt(init)),
        chars("C") + declarator + init + many(chars(",") + declarator + init),
    )
    within = alt(
        chars("O") + opt(chars("ω")) + chars(p("for")), chars("Ww") + chars(p("expr")), ident + chars(":"), chars(ELSE),
    )
    head = alt(chars("I") + chars(p("expr")), within)
    try_ = chars("Y") + chars(b("block")) + alt(
        chars("H") + opt(chars(p("params"))) + chars(b("block")) + opt(chars("L") + chars(b("block"))), chars("L") + chars(b("block"))
    )
    bare = ident + typed + many(chars(",") + ident + typed) + term  # declared names have no values
    ts_decl = alt(
        chars("ι") + ident + gen + opt(chars("e") + type_ + many(chars(",") + type_)) + chars(b("type")),
        chars("τ") + ident + gen + chars("=") + type_ + term,
        opt(chars("C")) + chars("u") + ident + chars(b("enum")),
        chars("ν") + alt(ident + many(chars(".") + ident), chars("s")) + chars(b("module")),
        chars("μ") + alt(chars("CVλ") + bare, decl + term, chars(FUNC, CLASS), chars("ν") + opt(alt(ident + many(chars(".") + ident), chars("s"))) + alt(chars(b("module", "ambient")), term)),
        opt(chars("μ")) + opt(chars("α")) + chars("F") + ident + gen + chars(p("params")) + typed + term,
    ) if ts else "(?!)"
    do_ = chars(DO) + chars(p("expr")) + opt(chars(";"))
    simple = alt(
        chars(";"), chars(b("block")), chars(FUNC, CLASS), decl + term, ts_decl, try_, do_, chars("S") + chars(p("expr")) + chars(b("switch")),
        chars("R") + f"(?:(?!{NL}){expr})?" + term, chars("T") + f"(?!{NL})" + expr + term, chars("B") + f"(?:(?!{NL}){ident})?" + term,
        chars("b") + term, f"(?!\n?[{BRACES[0]}-{BRACES[-1]}{FUNC}{CLASS}{ANON}]){expr}{term}",
    )
    stmt = f"(?>{many(head)}{simple})"
    # as a whole this stands before a statement like any other head; the nearest if takes the else, so none is open between
    else_ = chars("I") + chars(p("expr")) + f"(?>{many(within)}{simple})" + chars("E")
    do_head = chars("D") + stmt + chars("W")
    with_ = opt(chars("wi") + chars(b("object")))
    clause = alt(
        chars("*") + chars("δ") + ident, chars(b("names")), f"{ident}{opt(chars(',') + alt(chars(b('names')), chars('*') + chars('δ') + ident))}",
    )
    item = alt(
        chars("M") + chars("s") + with_ + term,
        chars("M") + (alt(chars("τ") + clause, clause) if ts else clause) + chars("φ") + chars("s") + with_ + term,
        chars("X") + chars("d") + alt(chars(FUNC, CLASS, ANON), (chars("ι") + ident + gen + chars(b("type"))) if ts else "(?!)", a + term),
        chars("X") + alt(chars(FUNC, CLASS), decl + term, ts_decl),
        chars("X") + (opt(chars("τ")) if ts else "") + alt(chars(b("names")) + opt(chars("φ") + chars("s") + with_), chars("*") + opt(chars("δ") + alt(word, chars("s"))) + chars("φ") + chars("s") + with_) + term,
        *([chars("M") + ident + chars("=") + expr + term, chars("X") + chars("=") + expr + term] if ts else []),
    )
    no_return = f"(?!(?:{head})*\n?R)" 
    method = opt(chars("σ")) + many(chars("αγ*")) + key + (opt(chars("?")) if ts else "") + gen + chars(p("params")) + typed
    prop = alt(
        chars("z") + a, many(chars("αγ*")) + key + gen + chars(p("params")) + typed + chars(b("block")), key + chars(":") + a, ident + opt(init),
    )
    pattern_prop = alt(chars("z") + binding, key + chars(":") + binding + opt(init), ident + opt(init))
    member = alt(
        chars(";"), decorator + mods + method + (alt(chars(b("block")), term) if ts else chars(b("block"))),
        decorator + mods + opt(chars("σ")) + key + (opt(chars("?!")) if ts else "") + typed + opt(init) + term,
        chars("σ") + chars(b("block")), *([mods + chars(s("signature")) + typed + term] if ts else []),
    )
    sep = alt(chars(";,"), f"(?={NL})", END)
    type_member = alt(
        many(chars("μγ")) + key + opt(chars("?")) + typed, key + opt(chars("?")) + gen + chars(p("params")) + typed, opt(chars("N")) + gen + chars(p("params")) + typed,
        opt(opt(chars("+")) + chars("μ")) + chars(s("signature")) + opt(opt(chars("+")) + chars("?")) + typed,
    )
    ambient = alt(
        item, ts_decl, opt(chars("X")) + chars("CVλ") + bare, chars(FUNC, CLASS), chars(";"),
        opt(chars("X")) + chars("ν") + opt(alt(ident + many(chars(".") + ident), chars("s"))) + chars(b("ambient")),
    )
    name_item = (opt(chars("τ")) if ts else "") + alt(word, chars("s")) + opt(chars("δ") + alt(word, chars("s")))
    return {
        "(args": listed(opt(chars("z")) + a),
        "(params": listed(param),
        "(for": alt(
            alt(decl, expr, "") + chars(";") + opt(expr) + chars(";") + opt(expr),
            alt(chars("VCλ") + binding + typed, f"(?>{primary}{many(suffix)})") + chars("nο") + expr,
        ),
        "(expr": expr,
        "(type": type_,
        "{block": many(stmt),
        "{module": many(alt(item, stmt)) if ts else "(?!)",
        "{ambient": many(ambient) if ts else "(?!)",
        "{object": listed(prop),
        "{pattern": listed(pattern_prop),
        "{class": many(member),
        "{switch": many(alt(chars("c") + expr, chars("d")) + chars(":") + many(stmt)),
        "{names": listed(name_item),
        "{type": many(type_member + sep) if ts else "(?!)",
        "{enum": listed(alt(word, chars("s")) + opt(init)) if ts else "(?!)",
        "[array": many(alt(chars(","), opt(chars("z")) + a + alt(chars(","), END))),
        "[pattern": many(alt(chars(","), opt(chars("z")) + binding + opt(init) + alt(chars(","), END))),
        "[index": expr,
        "[type": listed(opt(ident + opt(chars("?")) + chars(":")) + opt(chars("z")) + type_) if ts else "(?!)",
        "[signature": ident + alt(typed, chars("n") + type_ + opt(chars("δ") + type_)) if ts else "(?!)",
        "⟨": expr,
        "top": many(alt(item, no_return + stmt)),
        "func": func, "anon": anon, "class": class_, "arrow": arrow, "cond": cond, "arrow_block": chars(ARROW, TYPE_ARROW) + chars(b("block")),
        "else": else_, "do": do_head,
        "type_arrow": f"(?<![α{GENERIC}])" + gen + chars(p("params")) + "a" if ts else "(?!)",
        "type_cond": chars("e") + union + chars("?") + type_ + chars(":") if ts else "(?!)",
        "generic": chars("<") + listed(many(chars("Cκ")) + type_ + opt(chars("e") + type_) + opt(chars("=") + type_)) + chars(">") if ts else "(?!)",
    }


def _as(symbol: str, rx: re.Pattern, text: str) -> str:
    """Every match as one class; a line end before it stays."""
    return rx.sub(lambda m: NL + symbol if m.group()[0] == NL else symbol, text)


_PARTS = ("func", "anon", "class", "arrow", "cond", "arrow_block", "else", "do", "type_arrow", "type_cond", "generic")


class Grammar:
    def __init__(self, ts: bool):
        self.ts = ts
        self.source = productions(ts)
        self.rx = {k: re.compile(v if k in _PARTS else f"(?:{v}){NL}?") for k, v in self.source.items()}
        self.flat = lru_cache(200_000)(self._flat)
        self.group = lru_cache(200_000)(self._group)

    def _flat(self, content: str) -> str:
        """Functions, classes, arrows and conditionals of a window, each as one class."""
        rx = self.rx
        while self.ts and ("<" in content or "e" in content):
            new = _as(TYPE_COND, rx["type_cond"], _as(GENERIC, rx["generic"], content))
            if new == content:
                break
            content = new
        while True:
            new = content
            if "F" in new:
                new = _as(ANON, rx["anon"], _as(FUNC, rx["func"], new))
            if "K" in new:
                new = _as(CLASS, rx["class"], new)
            if "a" in new:
                new = _as(ARROW, rx["arrow"], _as(TYPE_ARROW, rx["type_arrow"], new) if self.ts else new)
                new = _as(BODY, rx["arrow_block"], new)
            if "?" in new:
                new = _as(COND, rx["cond"], new)
            if new == content:
                return new
            content = new

    def _paired(self, flat: str) -> str:
        """``if (x) statement else`` and ``do statement while`` as one class each, from the inside out."""
        while "E" in flat or "D" in flat:
            new = _as(DO, self.rx["do"], _as(ELSE, self.rx["else"], flat))
            if new == flat:
                break
            flat = new
        return flat

    def _fits(self, role: str, flat: str) -> bool:
        if role in STATEMENTS:
            flat = self._paired(flat)
        return self.rx[role].fullmatch(flat) is not None

    def _group(self, kind: str, content: str) -> str:
        """The class of a bracketed group, or "" if its contents fit no role."""
        flat = self.flat(content)
        if kind == "⟨":
            return SUBST if self._fits("⟨", flat) else ""
        roles = {"(": PAREN, "{": BRACE, "[": SQUARE}[kind]
        mask = 0
        for k, name in enumerate(roles.names):
            raw = content if name in ("params", "type", "signature") and not self.ts else flat
            if self._fits(kind + name, raw):
                mask |= 1 << k
        return roles.char(mask) if mask else ""

    def fault(self, tokens: str) -> str:
        """Why the token classes are no program, or ""; groups are reduced from the inside out."""
        stack: list[tuple[str, list[str]]] = []
        here: list[str] = []
        for ch in tokens:
            if ch in "([{⟨":
                stack.append((ch, here))
                here = []
            elif ch in ")]}⟩":
                if not stack:
                    return "bracket without its partner"
                kind, outer = stack.pop()
                got = self.group(kind, "".join(here))
                if not got:
                    return f"contents of {kind}"
                here = outer
                here.append(got)
            else:
                here.append(ch)
        if stack:
            return "bracket is not closed"
        flat = self.flat("".join(here))
        if not self._fits("top", flat):
            return "statement"
        return ""

    def pairs(self) -> set[tuple[str, str]]:
        """Permissible pairs of adjacent tokens."""
        kinds = (("(", ")", PAREN), ("{", "}", BRACE), ("[", "]", SQUARE))
        wrap = {roles.char(0): (o, c) for o, c, roles in kinds}
        expand = {roles.char(0): [self.source[o + n] for n in roles.names] for o, c, roles in kinds}
        wrap[SUBST], expand[SUBST] = ("⟨", "⟩"), [self.source["⟨"]]
        expand |= {FUNC: [self.source["func"]], ANON: [self.source["anon"]], BODY: [self.source["arrow_block"]], CLASS: [self.source["class"]], ARROW: [self.source["arrow"]], COND: [self.source["cond"]], ELSE: [self.source["else"]], DO: [self.source["do"]]}
        if self.ts:
            expand |= {GENERIC: [self.source["generic"]], TYPE_ARROW: [self.source["type_arrow"]], TYPE_COND: [self.source["type_cond"]]}
        return Pairs(expand, wrap, [PAREN, BRACE, SQUARE]).derive([self.source["top"]])


@lru_cache(2)
def grammar(ts: bool) -> Grammar:
    return Grammar(ts)
