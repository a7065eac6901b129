"""Boolean trigram queries from regular expressions.

A query is a tuple of clauses, all of which must hold; a clause is a set of alternatives, one of which must; an alternative is a
set of trigrams, all of which a text must have. Every text that holds a match of the expression satisfies its query,
in lower case; an expression without mandatory trigrams has the empty query, which every text satisfies.
"""

from __future__ import annotations

from itertools import product
from re import _constants as K
from re import _parser

Query = tuple[frozenset[frozenset[str]], ...]
#: Strings that a part of an expression may stand for, and characters of a class, to be followed one by one.
MOST_STRINGS, MOST_CHARS = 64, 16


def derive(pattern: str) -> Query:
    """The query of a regular expression (in the syntax of Python's module, case ignored)."""
    exact, clauses = _sequence(_parser.parse(pattern))
    return tuple(dict.fromkeys(clauses + _clause(exact) if exact is not None else clauses))


def satisfied(query: Query, text: str) -> bool:
    """Whether a text satisfies a query."""
    low = text.lower()
    return all(any(all(g in low for g in alternative) for alternative in clause) for clause in query)


def _clause(strings: frozenset[str]) -> Query:
    """What holds if one of ``strings`` is there; an alternative that another implies says nothing new."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if not all(sets):
        return ()
    return (frozenset(s for s in sets if not any(t < s for t in sets)),)


def _either(queries: list[Query]) -> Query:
    """What holds if one of ``queries`` does."""
    if not all(queries):
        return ()
    found: set[frozenset[str]] = set()
    for query in queries:
        ways = [frozenset()]
        for clause in sorted(query, key=len):
            if len(ways) * len(clause) <= MOST_STRINGS:  # a clause left out only weakens the query
                ways = [a | b for a, b in product(ways, clause)]
        if not all(ways):
            return ()
        found.update(ways)
    return (frozenset(s for s in found if not any(t < s for t in found)),)


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    """Parts one after another: all the strings they may stand for, if few, or else what a match must have."""
    run, clauses, broken = frozenset([""]), (), False
    for op, arg in items:
        exact, more = _part(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, exact))
            continue
        broken = True
        clauses += _clause(run) + more
        run = exact if exact is not None and len(exact) <= MOST_STRINGS else frozenset([""])
    return (None, clauses + _clause(run)) if broken else (run, ())


def _part(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is K.LITERAL:
        return (frozenset([chr(arg).lower()]), ()) if arg < 128 else (None, ())
    if op is K.IN:
        return _class(arg), ()
    if op is K.SUBPATTERN:
        return _sequence(arg[3])
    if op is K.ATOMIC_GROUP:
        return _sequence(arg)
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return frozenset([""]), ()
    if op is K.BRANCH:
        found = [_sequence(way) for way in arg[1]]
        if all(exact is not None for exact, _ in found):
            union = frozenset().union(*[exact for exact, _ in found])
            if len(union) <= MOST_STRINGS:
                return union, ()
        return None, _either([_clause(exact) if exact is not None else query for exact, query in found])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, body = arg
        if not least:
            exact, _ = _sequence(body)
            return (exact | {""}, ()) if most == 1 and exact is not None else (None, ())
        exact, query = _sequence([x for _ in range(min(least, 8)) for x in body])
        if exact is not None and least == most <= 8:
            return exact, ()
        return None, _clause(exact) if exact is not None else query
    return None, ()


def _class(items) -> frozenset[str] | None:
    """The characters of a class, if few."""
    found: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL and arg < 128:
            found.add(chr(arg).lower())
        elif op is K.RANGE and arg[1] < 128:
            found.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= MOST_CHARS else None
