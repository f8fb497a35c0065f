"""Boolean trigram queries of regular expressions.

A regex is read as a sequence of parts. A part that can only be one of a few strings (literals, alternatives, optional characters,
small classes) is exact; neighbouring exact parts join. Every match must hold one string of each exact run, and with it all
trigrams of that string: an OR of ANDs of trigrams. A run with a string of under three characters asks for nothing.
"""

from __future__ import annotations

import re
from itertools import product

#: Strings that one exact run may stand for.
MOST = 64
_tree = re._parser


def _exact(part) -> set[str] | None:
    """All strings that a part can be, None if they are many."""
    kind, arg = part
    name = str(kind)
    if name == "LITERAL":
        return {chr(arg)}
    if name == "SUBPATTERN":
        return _exact_all(arg[-1])
    if name == "BRANCH":
        sets = [_exact_all(x) for x in arg[1]]
        return set().union(*sets) if None not in sets else None
    if name == "IN":
        found: set[str] = set()
        for k, x in arg:
            if str(k) == "LITERAL":
                found.add(chr(x))
            elif str(k) == "RANGE" and x[1] - x[0] < MOST:
                found |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        one = _exact_all(inner)
        if one is None or int(high) > 4:
            return None
        return {"".join(x) for n in range(low, int(high) + 1) for x in product(sorted(one), repeat=n)} if len(one) ** int(high) <= MOST else None
    if name in ("ASSERT", "ASSERT_NOT", "AT"):
        return {""}
    return None


def _exact_all(parts) -> set[str] | None:
    found = {""}
    for part in parts:
        more = _exact(part)
        if more is None or len(found) * len(more) > MOST:
            return None
        found = {a + b for a in found for b in more}
    return found


def query(regex: str) -> list[frozenset[str]]:
    """Lower-cased trigrams: a text can hold a match only if it holds all trigrams of one of the sets. Empty: no trigram is mandatory."""
    runs, now = [], {""}
    for part in _tree.parse(regex):
        more = _exact(part)
        if more is None or len(now) * len(more) > MOST:
            runs.append(now)
            now = more or {""}
        else:
            now = {a + b for a in now for b in more}
    runs.append(now)
    asked = [{frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in run} for run in runs if all(len(s) >= 3 for s in run)]
    if not asked:
        return []
    best = max(asked, key=lambda sets: min(map(len, sets)))  # the run whose weakest set asks for most
    return sorted((s for s in best if not any(t < s for t in best)), key=sorted)
