"""Packrat parsing expressions: a rule is a function from (state, position) to (end, values), or None where it fails.

Every rule remembers its result per position, so that a parse takes time linear in the
text, and no rule calls itself: what nests without bound (brackets) is one terminal with
a stack of its own. Values keep their source offsets as ``(label, start, end)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Value = tuple[str, int, int]
Result = tuple[int, tuple[Value, ...]] | None
_NEW = object()


class State:
    def __init__(self, text: str):
        self.text, self.memo = text, {}


Rule = Callable[[State, int], Result]


def _packrat(rule: Rule) -> Rule:
    """A rule that looks its result up where it has been tried before."""

    def run(s: State, i: int) -> Result:
        key = (run, i)
        got = s.memo.get(key, _NEW)
        if got is _NEW:
            got = s.memo[key] = rule(s, i)
        return got

    return run


def rx(pattern: str, label: str | None = None) -> Rule:
    """A terminal; with a label its span becomes a value."""
    match = re.compile(pattern).match

    def run(s: State, i: int) -> Result:
        m = match(s.text, i)
        return None if m is None else (m.end(), ((label, i, m.end()),) if label else ())

    return _packrat(run)


def seq(*rules: Rule) -> Rule:
    def run(s: State, i: int) -> Result:
        out: tuple[Value, ...] = ()
        for r in rules:
            got = r(s, i)
            if got is None:
                return None
            i, out = got[0], out + got[1]
        return i, out

    return _packrat(run)


def either(*rules: Rule) -> Rule:
    """The first rule that matches (ordered choice)."""

    def run(s: State, i: int) -> Result:
        for r in rules:
            got = r(s, i)
            if got is not None:
                return got
        return None

    return _packrat(run)


def many(rule: Rule, least: int = 0) -> Rule:
    def run(s: State, i: int) -> Result:
        out: list[Value] = []
        n = 0
        while (got := rule(s, i)) is not None and got[0] > i:
            i, n = got[0], n + 1
            out += got[1]
        return (i, tuple(out)) if n >= least else None

    return _packrat(run)


def maybe(rule: Rule) -> Rule:
    return _packrat(lambda s, i: rule(s, i) or (i, ()))


def span(label: str, rule: Rule) -> Rule:
    """Adds the whole stretch that a rule covers as a value, after those inside it."""

    def run(s: State, i: int) -> Result:
        got = rule(s, i)
        return None if got is None else (got[0], (*got[1], (label, i, got[0])))

    return _packrat(run)


def balanced(strings: str) -> Rule:
    """( ), [ ] or { } with anything balanced inside, to any depth; brackets in ``strings`` do not count; an end of text closes all."""
    token = re.compile(f"(?:{strings})|[()\\[\\]{{}}]|[^()\\[\\]{{}}\"'`/]+|[\\s\\S]")
    closes = {"(": ")", "[": "]", "{": "}"}

    def run(s: State, i: int) -> Result:
        if s.text[i : i + 1] not in closes:
            return None
        stack = [closes[s.text[i]]]
        i += 1
        while stack and (m := token.match(s.text, i)):
            piece, i = m.group(), m.end()
            if piece in closes:
                stack.append(closes[piece])
            elif piece in (")", "]", "}") and piece != stack.pop():
                return None
        return i, ()

    return _packrat(run)
