"""Similarities that have no native expression, as Arrow-batched functions."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def edit_distance(a: str, b: str, most: int = 3) -> int | None:
    """Edits between two names, None past ``most``. A swap costs one, but is only looked for on or above the diagonal, with both names read at the column."""
    if abs(len(a) - len(b)) > most:
        return None
    two, one = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if two is not None and 1 < i <= j <= len(a) and a[j - 1] == b[j - 2] and a[j - 2] == b[j - 1] and a[j - 1] != b[j - 1]:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return None
        two, one = one, row
    return one[-1] if one[-1] <= most else None


@pandas_udf(T.IntegerType())
def name_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def ratio_at_least(a: str, b: str, least: float = 0.8) -> float | None:
    """The matching share of two texts, None if it or a cheaper upper bound of it is below ``least``."""
    m = difflib.SequenceMatcher(None, a, b)
    if m.real_quick_ratio() < least or m.quick_ratio() < least:
        return None
    r = m.ratio()
    return r if r >= least else None


@pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_at_least(x, y) for x, y in zip(a, b)], dtype="Float64")


def lz_set(data: bytes) -> set[int]:
    """Hashes of the phrases of a Lempel-Ziv walk: each grows until it is new."""
    out: set[int] = set()
    h = 0
    for x in data:
        h = (h * 0x100000001B3 + x + 1) & 0x7FFFFFFFFFFFFFFF
        if h not in out:
            out.add(h)
            h = 0
    return out


@pandas_udf(T.ArrayType(T.LongType()))
def lz_hashes(text: pd.Series) -> pd.Series:
    """The phrases' hashes, distinct and in an order that mixes them: the first are a sketch of the set."""
    mixed = lambda x: np.array(sorted(x, key=lambda v: (v * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF), np.int64)
    return pd.Series([None if t is None else mixed(lz_set(t.encode() if isinstance(t, str) else bytes(t))) for t in text])


def path_edits(a: str, b: str) -> int:
    """Parts that differ between two paths: of each stretch that isn't equal, the longer side."""
    x, y = a.split("/"), b.split("/")
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if tag != "equal")


@pandas_udf(T.IntegerType())
def path_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([path_edits(x, y) for x, y in zip(a, b)])


@pandas_udf(T.StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(["".join(difflib.unified_diff((x or "").splitlines(True), (y or "").splitlines(True))) for x, y in zip(a, b)])


@pandas_udf(T.LongType())
def xxh32(text: pd.Series) -> pd.Series:
    import xxhash

    return pd.Series([None if t is None else xxhash.xxh32_intdigest(t.encode()) for t in text], dtype="Int64")


@pandas_udf(T.LongType())
def xxh64(text: pd.Series) -> pd.Series:
    """As a signed 64-bit integer, seed 0."""
    import xxhash

    return pd.Series([None if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode())).astype(np.int64)) for t in text], dtype="Int64")
