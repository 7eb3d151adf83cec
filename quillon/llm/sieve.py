"""A Bloom filter of a table's keys that map tasks can ask before anything is shuffled.

It only saves work: what it lets through by mistake, an exact join behind it takes out, so it may
be as coarse as it likes. Its bits grow with the keys up to ``MOST_BITS`` (32 MB to broadcast); beyond
that it lets more through and the join does the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import textwords as tw

U64 = np.uint64
MOST_BITS = 1 << 28
_HASHES = 4


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, a row a hash."""
    h = tw.mix(keys.view(U64) + U64(0x9E3779B97F4A7C15))
    step = (h >> U64(32)) | U64(1)
    return np.stack([(h + U64(i) * step) & U64(bits - 1) for i in range(_HASHES)])


class Sieve:
    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the table; false only if it surely isn't."""
        out = np.ones(len(keys), bool)
        for at in places(keys, 64 * len(self.words)):
            out &= (self.words[at >> U64(6)] >> (at & U64(63))) & U64(1) != 0
        return out


def through(some):
    """A function of a column: whether the broadcast sieve ``some`` lets a key through; nulls don't go through."""

    @F.arrow_udf(T.BooleanType())
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(some.value.has(keys.fill_null(0).cast(pa.int64()).to_numpy()) & keys.is_valid().to_numpy(zero_copy_only=False))

    return may


def of(keys: DataFrame, column: str):
    """The broadcast sieve of a long column; null keys are left out."""
    spark = keys.sparkSession
    n = keys.count()
    bits = 1 << 16
    while bits < 12 * n and bits < MOST_BITS:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, U64)
        for batch in batches:
            at = places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(words, at >> U64(6), U64(1) << (at & U64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], names=["word", "mask"])

    table = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, U64)
    words[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(U64)
    return spark.sparkContext.broadcast(Sieve(words))
