"""Boolean trigram queries of regular expressions.

A text that matches an expression holds the trigrams that the query asks for. Read are literals, classes, groups,
alternatives and the quantifiers ?, *, + and {m,n}. Letters are folded to lower case on both sides, which can only add
candidates. A query is ALL (no text is excluded), ("tri", t), ("and", [..]) or ("or", [..]).
"""

from __future__ import annotations

from dataclasses import dataclass

ALL = ("all",)
#: Sets of exact strings stop growing at this size; beyond it their trigrams are asked for instead.
MOST = 32


@dataclass
class _Info:
    """What a part of the expression matches: all its strings if known, else the query that its matches imply."""

    exact: frozenset[str] | None
    query: tuple


def conj(a: tuple, b: tuple) -> tuple:
    if a == ALL or a == b:
        return b
    if b == ALL:
        return a
    parts: list = []
    for q in (a, b):
        for x in q[1] if q[0] == "and" else [q]:
            if x not in parts:
                parts.append(x)
    return ("and", parts)


def disj(a: tuple, b: tuple) -> tuple:
    if ALL in (a, b):
        return ALL
    if a == b:
        return a
    parts: list = []
    for q in (a, b):
        for x in q[1] if q[0] == "or" else [q]:
            if x not in parts:
                parts.append(x)
    return ("or", parts)


def _of_strings(strings: frozenset[str]) -> tuple:
    """Some of the strings is found whole: or over strings, and over a string's trigrams."""
    out: tuple | None = None
    for s in sorted(strings):
        q = ALL
        for i in range(len(s) - 2):
            q = conj(q, ("tri", s[i : i + 3]))
        out = q if out is None else disj(out, q)
    return ALL if out is None else out


def _closed(x: _Info) -> _Info:
    """The part as a query alone."""
    return x if x.exact is None else _Info(None, _of_strings(x.exact))


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternatives(self) -> _Info:
        out = self.sequence()
        while self.peek() == "|":
            self.i += 1
            other = self.sequence()
            if out.exact is not None and other.exact is not None and len(out.exact | other.exact) <= MOST:
                out = _Info(out.exact | other.exact, ALL)
            else:
                out = _Info(None, disj(_closed(out).query, _closed(other).query))
        return out

    def sequence(self) -> _Info:
        query, run = ALL, frozenset([""])  # run: the strings of the parts since the last inexact one
        exact = True
        while self.peek() not in ("", "|", ")"):
            part = self.repeated()
            if part.exact is not None and len(run) * len(part.exact) <= MOST:
                run = frozenset(a + b for a in run for b in part.exact)
                continue
            exact = False
            query = conj(query, _of_strings(run))
            if part.exact is not None and len(part.exact) <= MOST:
                run = part.exact
            else:
                query, run = conj(query, _closed(part).query), frozenset([""])
        return _Info(run, ALL) if exact else _Info(None, conj(query, _of_strings(run)))

    def repeated(self) -> _Info:
        out = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.p[self.i]
            self.i += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, None)}[c]
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i : end].partition(",")
                least, most = int(low or 0), int(high) if high else (None if "," in self.p[self.i : end] else int(low))
                self.i = end + 1
            if self.peek() and self.peek() in "?+":
                self.i += 1
            if (least, most) == (1, 1):
                continue
            if (least, most) == (0, 1) and out.exact is not None and len(out.exact) < MOST:
                out = _Info(out.exact | {""}, ALL)
            elif least == 0:
                out = _Info(None, ALL)
            elif out.exact is not None and least == most and len(out.exact) ** least <= MOST:
                whole = frozenset([""])
                for _ in range(least):
                    whole = frozenset(a + b for a in whole for b in out.exact)
                out = _Info(whole, ALL)
            else:
                out = _closed(out)
        return out

    def atom(self) -> _Info:
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p.startswith("?", self.i):
                kind = self.p[self.i : self.i + 2]
                if kind != "?:":
                    raise ValueError(f"group {kind} isn't read: {self.p}")
                self.i += 2
            out = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"a group isn't closed: {self.p}")
            self.i += 1
            return out
        if c == "[":
            return self.char_class()
        if c == ".":
            return _Info(None, ALL)
        if c in "^$":
            return _Info(frozenset([""]), ALL)
        if c == "\\":
            return self.escape()
        return _Info(frozenset([c.lower()]), ALL)

    def escape(self) -> _Info:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return _Info(frozenset([chr(int(self.p[self.i - 2 : self.i], 16)).lower()]), ALL)
        if c in "bB":
            return _Info(frozenset([""]), ALL)
        if c.isalnum():
            return _Info(None, ALL)
        return _Info(frozenset([c]), ALL)

    def char_class(self) -> _Info:
        negated = self.peek() == "^"
        self.i += negated
        chars: set[str] | None = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.p[self.i]
            self.i += 1
            if c == "\\":
                c = self.p[self.i]
                self.i += 1
                if c == "x":
                    c = chr(int(self.p[self.i : self.i + 2], 16))
                    self.i += 2
                elif c.isalnum():
                    chars = None
                    continue
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                end = self.p[self.i + 1]
                self.i += 2
                if end == "\\":
                    raise ValueError(f"a range that ends in an escape isn't read: {self.p}")
                if chars is not None:
                    chars |= {chr(x) for x in range(ord(c), ord(end) + 1)}
            elif chars is not None:
                chars.add(c)
        self.i += 1
        if negated or chars is None or len(folded := {x.lower() for x in chars}) > 8:
            return _Info(None, ALL)
        return _Info(frozenset(folded), ALL)


def query_of(pattern: str) -> tuple:
    """The trigram query of an expression; ALL if no trigram is mandatory."""
    if pattern.startswith("(?i)"):
        pattern = pattern[4:]
    parser = _Parser(pattern)
    info = parser.alternatives()
    if parser.i != len(pattern):
        raise ValueError(f"can't read {pattern} from {parser.i}")
    return _closed(info).query


def trigrams_of(query: tuple) -> list[str]:
    """The trigrams that a query mentions, in order."""
    if query == ALL:
        return []
    if query[0] == "tri":
        return [query[1]]
    return sorted({t for q in query[1] for t in trigrams_of(q)})


def trie(trigrams: list[str]) -> str:
    """A group that matches any of the trigrams, by their first, second and third characters in turn."""
    by: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(trigrams):
        by.setdefault(a, {}).setdefault(b, []).append(c)
    quoted = lambda x: x if x.isalnum() or ord(x) > 127 else "\\" + x
    second = lambda nxt: "|".join(quoted(b) + "[" + "".join(map(quoted, cs)) + "]" for b, cs in nxt.items())
    return "(" + "|".join(f"{quoted(a)}(?:{second(nxt)})" for a, nxt in by.items()) + ")"


def holds(query: tuple, present) -> bool:
    """The query over a set of trigrams; the plain meaning, for tests."""
    if query == ALL:
        return True
    if query[0] == "tri":
        return query[1] in present
    return (all if query[0] == "and" else any)(holds(q, present) for q in query[1])
