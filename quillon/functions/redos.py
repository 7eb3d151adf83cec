"""Regular expressions whose matching can take exponential time."""

from __future__ import annotations

import re._constants as c
import re._parser as parser

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_LARGE = 10
_REPEATS = {c.MAX_REPEAT, c.MIN_REPEAT}


def _first(items) -> set:
    """The literals that the items can begin with; "any" for what isn't a literal."""
    for op, arg in items:
        if op is c.LITERAL:
            return {arg}
        if op is c.IN:
            return {x[1] if x[0] is c.LITERAL else "any" for x in arg}
        if op is c.SUBPATTERN:
            return _first(arg[-1])
        if op is c.BRANCH:
            return set().union(*(_first(b) for b in arg[1]))
        if op in _REPEATS:
            return _first(arg[2]) | ({"any"} if arg[0] == 0 else set())
        if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            continue
        return {"any"}
    return set()


def _overlap(branches) -> bool:
    heads = [_first(b) for b in branches]
    return any(x & y or "any" in x and y or "any" in y and x for i, x in enumerate(heads) for y in heads[i + 1 :])


def _walk(items, depth: int) -> bool:
    """A large quantifier within a large one, or alternatives that begin alike under one."""
    for op, arg in items:
        if op in _REPEATS:
            low, high, inner = arg
            inside = depth + (high is c.MAXREPEAT or high >= _LARGE)
            if inside > 1 and inside > depth or _walk(inner, inside):
                return True
        elif op is c.SUBPATTERN:
            if _walk(arg[-1], depth):
                return True
        elif op is c.BRANCH:
            if depth and (_overlap(arg[1]) or "prefix" in _common(arg[1])):
                return True
            if any(_walk(b, depth) for b in arg[1]):
                return True
        elif op in (c.ASSERT, c.ASSERT_NOT) and _walk(arg[1], depth):
            return True
    return False


def _common(branches) -> set[str]:
    return {"prefix"} if any(not len(b) for b in branches) else set()


def is_risky(pattern: str | None) -> bool:
    """False for what can't be parsed."""
    if pattern is None:
        return False
    try:
        parsed = parser.parse(pattern)
    except Exception:
        return False
    # The parser moves a common head out of alternatives, which then begin with what is left.
    return _walk(parsed, 0)


@pandas_udf(T.BooleanType())
def risky(pattern: pd.Series) -> pd.Series:
    return pattern.map(is_risky)
