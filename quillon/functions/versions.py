"""Versions and requirements of packages: a sortable key, specifiers and markers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_PARTS = re.compile(r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?(\d*))?(?:(?:[-_.]?(?:post|rev|r)[-_.]?(\d*))|-(\d+))?(?:[-_.]?dev[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$", re.I)
_PRE = {"a": 0, "alpha": 0, "b": 1, "beta": 1, "c": 2, "rc": 2, "pre": 2, "preview": 2}
_INF = 1 << 40


def version_key(text: str | None) -> list[int] | None:
    """Numbers that order versions: epoch, eight parts of the release, then how it stands to pre, post and development releases. None if it is no version."""
    m = _PARTS.match(text or "")
    if not m:
        return None
    epoch, release, pre, pre_n, post, post_dash, dev, _ = m.groups()
    numbers = [int(x) for x in release.split(".")][:8]
    while numbers and not numbers[-1]:
        numbers.pop()
    is_post = post is not None or post_dash is not None
    if pre:
        stage = [_PRE[pre.lower()], int(pre_n or 0)]
    elif dev is not None and not is_post:
        stage = [-1, 0]
    else:
        stage = [3, 0]
    return [int(epoch or 0), *numbers, *([0] * (8 - len(numbers))), *stage, int(post or post_dash or 0) + 1 if is_post else 0, int(dev or 0) if dev is not None else _INF]


_OPS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def satisfies(version: str, specifier: str) -> bool:
    """Whether a version is within a comma-separated specifier; false if either can't be read."""
    key = version_key(version)
    if key is None:
        return False
    for clause in filter(None, (x.strip() for x in specifier.split(","))):
        m = re.match(r"^(===|~=|==|!=|<=|>=|<|>)\s*(.+?)$", clause)
        if not m:
            return False
        op, other = m.groups()
        if op == "===":
            if version != other:
                return False
            continue
        wild = other.endswith(".*")
        bound = version_key(other[:-2] if wild else other)
        if bound is None:
            return False
        if wild:
            n = len(other[:-2].split("."))
            same = key[: 1 + n] == bound[: 1 + n]
            if same != (op == "=="):
                return False
        elif op == "~=":
            n = len(re.match(r"[\d.]+", other).group().rstrip(".").split(".")) - 1
            if key < bound or key[: 1 + n] != bound[: 1 + n]:
                return False
        elif not _OPS[op](key, bound):
            return False
    return True


@pandas_udf(T.ArrayType(T.LongType()))
def sort_key(version: pd.Series) -> pd.Series:
    return version.map(version_key)


def order_key(version: Column) -> Column:
    """As :func:`sort_key`; of versions of digits and dots alone, most of them, Python gets a null, not the text."""
    plain = version.rlike(r"\A[0-9]{1,18}(?:\.[0-9]{1,18})*\z")
    zero = F.lit(0).cast("long")
    release = F.slice(F.concat(F.transform(F.split(version, "[.]"), lambda x: x.cast("long")), F.array_repeat(zero, 8)), 1, 8)
    native = F.concat(F.array(zero), release, F.array(*(F.lit(x).cast("long") for x in (3, 0, 0, _INF))))
    return F.when(plain, native).otherwise(sort_key(F.when(~plain, version)))


@pandas_udf(T.BooleanType())
def within(version: pd.Series, specifier: pd.Series) -> pd.Series:
    return pd.Series([v is not None and s is not None and satisfies(v, s) for v, s in zip(version, specifier)])


def plain_key(version: Column, parts: int = 4) -> Column:
    """As :func:`sort_key`, natively, for versions of digits and dots alone."""
    numbers = F.transform(F.split(version, "\\."), lambda x: x.cast("long"))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), parts)), 1, parts)


_REQUIREMENT = re.compile(r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[([^\]]*)\])?\s*(?:\(([^)]*)\)|([^;@]*))?\s*(?:@\s*([^;]+))?\s*(?:;\s*(.*))?$")


def parse_requirement(line: str) -> dict | None:
    """{name, extras, specifier, url, marker}, None if it is no requirement."""
    m = _REQUIREMENT.match(line.strip())
    if not m:
        return None
    name, extras, inner, outer, url, marker = m.groups()
    spec = (inner or outer or "").replace(" ", "")
    if spec and not all(re.match(r"^(===|~=|==|!=|<=|>=|<|>)[^=<>~!]+$", c) for c in spec.split(",")):
        return None
    return {"name": name, "extras": [x.strip() for x in (extras or "").split(",") if x.strip()], "specifier": spec, "url": url.strip() if url else None, "marker": marker}


def marker_allows(marker: str | None, extras: set[str]) -> bool:
    """Only clauses of the form extra == x are judged; all others hold."""
    wanted = re.findall(r"extra\s*==\s*['\"]([^'\"]+)['\"]", marker or "")
    return all(x in extras for x in wanted)
