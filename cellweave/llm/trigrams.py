"""The trigrams that a regular expression cannot match without, as a Boolean query.

A query is a list of alternatives, each a set of trigrams that must all be there;
an empty list of alternatives stands for "any text". All is in lower case, so one
index serves rules that mind the case and rules that do not.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser as P

Query = list[frozenset[str]]
ANY: Query = []
#: Alternatives that are followed at once; beyond them the strings so far are turned into trigrams.
MOST = 64


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(options: Query) -> Query:
    """Without what another alternative implies; an alternative without trigrams is any text."""
    options = sorted(set(options), key=lambda o: (len(o), sorted(o)))
    if options and not options[0]:
        return ANY
    return [o for i, o in enumerate(options) if not any(p <= o for p in options[:i])]


def both(a: Query, b: Query) -> Query:
    if not a or not b:
        return a or b
    joined = _least([x | y for x in a for y in b])
    return joined if len(joined) <= MOST else min(a, b, key=len)


def either(queries: list[Query]) -> Query:
    return ANY if any(q == ANY for q in queries) else _least([o for q in queries for o in q])


def _told(strings: set[str]) -> Query:
    return _least([_grams(s) for s in strings])


def _class(items: list) -> set[str] | None:
    """The characters of a class, if few."""
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _sequence(items) -> tuple[set[str] | None, Query]:
    """(all strings that it matches, if few; what any text that has a match holds)."""
    strings, query, whole = {""}, ANY, True
    for op, value in items:
        exact, needs = _item(op, value)
        if exact is not None and len(strings) * len(exact) <= MOST:
            strings = {a + b for a in strings for b in exact}
            continue
        query = both(query, _told(strings))
        if exact is not None:
            strings, whole = exact, False
        else:
            query, strings, whole = both(query, needs), {""}, False
    return (strings, _told(strings)) if whole else (None, both(query, _told(strings)))


def _item(op, value) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(value).lower()}, ANY
    if op is C.IN:
        return _class(value), ANY
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(e is not None for e, _ in parts):
            return set().union(*(e for e, _ in parts)), ANY
        return None, either([q for _, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        exact, query = _sequence(inner)
        if exact is not None and high <= 4 and sum(len(exact) ** n for n in range(low, high + 1)) <= MOST:
            out, power = set(), {""}
            for n in range(high + 1):
                if n >= low:
                    out |= power
                power = {a + b for a in power for b in exact}
            return out, ANY
        return None, query if low else ANY
    if op is C.AT:
        return {""}, ANY
    return None, ANY


def query_of(pattern: str) -> Query:
    """The query of a pattern; :data:`ANY` if it has no mandatory trigrams."""
    return _sequence(P.parse(pattern))[1]
