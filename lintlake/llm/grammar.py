"""Token-class grammars: productions as patterns over one character per token.

A production is a regular expression over token classes in which a bracketed group counts as one class that says
which roles its contents can play (arguments, parameters, block, object ...). Reducing groups from the inside out
turns nesting into flat windows that the patterns decide. The permissible pairs of adjacent tokens are derived from
the same patterns by the usual first/last/follow sets.
"""

from __future__ import annotations

import re
from re import _parser as sre  # the parsed form of a pattern, for first and last sets

NL = "\n"
#: In pairs, stands for the end of a line that ends a statement.
LINE_END = "␤"
#: Where a window ends; in pairs its stand-in is CLOSE, which becomes the closing bracket or the end of the file.
END = "(?=\n?\\Z)"
CLOSE = "␃"


def chars(*cs: str) -> str:
    """One token of these classes, with an optional line end before it."""
    body, run = [], ""
    for c in [*sorted(set("".join(cs))), ""]:
        if run and c and ord(c) == ord(run[-1]) + 1 and ord(c) >= 0xE000:
            run += c
            continue
        body.append(f"{run[0]}-{run[-1]}" if len(run) > 2 else "".join("\\" + x if x in "\\]^-[" else x for x in run))
        run = c
    return f"\n?[{''.join(body)}]"


def alt(*xs: str) -> str:
    return "(?:" + "|".join(xs) + ")"


def opt(x: str) -> str:
    return f"(?:{x})?"


def many(x: str) -> str:
    return f"(?:{x})*"


def listed(item: str, comma: str = "\n?,") -> str:
    """Items with commas between, one more allowed at the end; or nothing."""
    return f"(?:{item}(?:{comma}{item})*(?:{comma})?)?"


class Roles:
    """The classes of one kind of bracket: a character for each set of roles."""

    def __init__(self, base: int, names: list[str]):
        self.base, self.names = base, names

    def char(self, mask: int) -> str:
        return chr(self.base + mask)

    def having(self, *names: str) -> str:
        bits = [1 << self.names.index(n) for n in names]
        return "".join(self.char(m) for m in range(1 << len(self.names)) if any(m & b for b in bits))


Sets = tuple[bool, frozenset, frozenset]


class Pairs:
    """Adjacent terminals that patterns permit. ``expand`` has the patterns behind a class that stands for several tokens."""

    def __init__(self, expand: dict[str, list[str]], wrap: dict[str, tuple[str, str]], roles: list[Roles] = []):
        self.expand, self.wrap, self.roles = expand, wrap, roles
        self.edges: dict[str, Sets] = {}
        self.known: dict = {}  # items seen before, as most classes stand in many places
        self.raw: set[tuple[str, str]] = set()

    def _symbols(self, op, av) -> frozenset:
        """Classes that an item matches; of a bracket's classes one stands for all, as they begin and end alike."""
        key = av if op is sre.LITERAL else tuple(av)
        if key not in self.known:
            self.known[key] = frozenset(self._reduced(op, av) - {NL})
        return self.known[key]

    def _reduced(self, op, av) -> set[str]:
        out = self._members(op, av)
        for r in self.roles:
            if any(r.base <= ord(c) < r.base + (1 << len(r.names)) for c in out):
                out = {c for c in out if not r.base <= ord(c) < r.base + (1 << len(r.names))} | {r.char(0)}
        return out

    def _members(self, op, av) -> set[str]:
        if op is sre.LITERAL:
            return {chr(av)}
        out: set[str] = set()
        for o, a in av:
            if o is sre.LITERAL:
                out.add(chr(a))
            elif o is sre.RANGE:
                out |= {chr(c) for c in range(a[0], a[1] + 1)}
        return out

    def _walk(self, items) -> Sets:
        """(can be empty, first symbols, last symbols) of a sequence; adds the pairs inside it."""
        empty, first, last = True, frozenset(), frozenset()
        for op, av in items:
            if op in (sre.LITERAL, sre.IN):
                got = self._symbols(op, av)
                e, f, la = not got, got, got
            elif op is sre.SUBPATTERN:
                e, f, la = self._walk(av[3])
            elif op is sre.ATOMIC_GROUP:
                e, f, la = self._walk(av)
            elif op is sre.BRANCH:
                parts = [self._walk(x) for x in av[1]]
                e = any(p[0] for p in parts)
                f, la = frozenset().union(*(p[1] for p in parts)), frozenset().union(*(p[2] for p in parts))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                e, f, la = self._walk(av[2])
                if av[1] > 1:
                    self.raw |= {(a, b) for a in la for b in f}
                e = e or av[0] == 0
            elif op is sre.ASSERT and av[1] and av[1][0] == (sre.LITERAL, ord(NL)):
                e, f, la = False, frozenset({LINE_END}), frozenset({LINE_END})  # what follows stands on another line
            elif op is sre.ASSERT and any(x[0] is sre.AT for x in av[1]):
                e, f, la = False, frozenset({CLOSE}), frozenset({CLOSE})
            else:  # other anchors and assertions take no token
                continue
            self.raw |= {(a, b) for a in last for b in f}
            first, last = (first | f if empty else first), (last | la if e else la)
            empty = empty and e
        return empty, first, last

    def add(self, pattern: str) -> Sets:
        if pattern not in self.edges:
            self.edges[pattern] = self._walk(sre.parse(pattern))
        return self.edges[pattern]

    def _before(self, last: frozenset) -> set[str]:
        """Last tokens; where a pattern looks ahead for the end, the tokens that may stand there."""
        out = set(last) - {CLOSE}
        return out | {a for a, b in self.raw if b == CLOSE} - {CLOSE} if CLOSE in last else out

    def derive(self, tops: list[str]) -> set[tuple[str, str]]:
        """Pairs of terminals within a line, with ``^`` before the first and ``$`` after the last token of a file."""
        self.raw = set()
        ends: dict[str, Sets] = {}
        for symbol, patterns in self.expand.items():
            got = [self.add(p) for p in patterns]
            ends[symbol] = (any(g[0] for g in got), frozenset().union(*(g[1] for g in got)), frozenset().union(*(g[2] for g in got)))
        for p in tops:
            e, f, la = self.add(p)
            self.raw |= {("^", x) for x in f} | {(x, "$") for x in self._before(la)} | ({("^", "$")} if e else set())
        for symbol, (o, c) in self.wrap.items():
            e, f, la = ends[symbol]
            self.raw |= {(o, x) for x in f} | {(x, c) for x in self._before(la)} | ({(o, c)} if e else set())
        first = {s: ({self.wrap[s][0]} if s in self.wrap else set(ends[s][1])) for s in ends}
        last = {s: ({self.wrap[s][1]} if s in self.wrap else set(ends[s][2])) for s in ends}

        def close(sets: dict[str, set[str]], s: str) -> set[str]:
            out, todo, seen = set(), [s], set()
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                if x in sets:
                    todo += list(sets[x])
                else:
                    out.add(x)
            return out

        cf: dict[str, set[str]] = {}
        cl: dict[str, set[str]] = {}
        for a, b in self.raw:
            if a not in cl:
                cl[a] = close(last, a)
            if b not in cf:
                cf[b] = close(first, b)
        return {(x, y) for a, b in self.raw for x in cl[a] for y in cf[b]}
