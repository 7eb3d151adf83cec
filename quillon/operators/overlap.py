"""Pairs of two collections of sets whose Jaccard similarity may reach a bound, none missed, by counts over their rarest elements.

Elements are ordered by how often their bucket occurs, rarest first. Two sets of sizes m and n that share ``least`` of their union
share k = ceil(least / (1 + least) * (m + n)) elements at least. Of the first m - k + s and n - k + s of them, s are in both: the side whose
prefix ends earlier has at most m - k (or n - k) of its elements that aren't among the k, and all its others lie before the end of both. With s a share of the size,
sets that have only single elements in common are dropped by a count. Sets are compared by classes of like sizes, a block of the right side
held as an index in a task, the left side streamed past it; what a task holds is bounded by ``BLOCK`` elements.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the table of frequencies, of one byte each.
BUCKETS = 20
#: Elements of the index that a task holds, of what it sends at once, and of what it counts at once, which stays in a core's cache.
BLOCK, BATCH, TILE = 1 << 22, 1 << 20, 1 << 16
#: Classes of sizes an e-fold; the share of the larger size, and the number if that is more, that has to be met within the prefixes.
CLASSES, SHARE, LEAST = 8, 0.06, 48


def _mixed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values and the offsets of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _levels(*sides: DataFrame) -> np.ndarray:
    """For each bucket of elements the logarithm of how often they occur, eight steps a doubling."""

    def counted(batches):
        total = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            at = _mixed(_lists(batch.column(0))[0]) >> np.uint64(64 - BUCKETS)
            total += np.bincount(at.astype(np.int64), minlength=1 << BUCKETS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + BATCH].astype(np.int32)), pa.array(total[at[i : i + BATCH]])], ["bucket", "n"])

    each = sides[0].select("hashes")
    for t in sides[1:]:
        each = each.union(t.select("hashes"))
    found = each.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKETS, np.uint8)
    out[found["bucket"].to_numpy()] = np.minimum(255, np.round(8 * np.log2(1 + found["n"].to_numpy())))
    return out


def _ranked(t: DataFrame, levels) -> DataFrame:
    """(path, n, class, elements): 32 bits of each element, rarest first. Two elements that agree in these can only raise a count."""

    def run(batches):
        for batch in batches:
            values, offsets = _lists(batch.column(1))
            mixed, n = _mixed(values), np.diff(offsets)
            level = levels.value[(mixed >> np.uint64(64 - BUCKETS)).astype(np.int64)].astype(np.uint64)
            short = mixed >> np.uint64(32)
            order = (level << np.uint64(32)) | short
            for i in range(len(n)):
                order[offsets[i] : offsets[i + 1]].sort()
            elements = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(order.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array(np.floor(np.log(n) * CLASSES).astype(np.int32)), elements], ["path", "n", "class", "elements"])

    return t.where(F.size("hashes") > 0).select("path", "hashes").mapInArrow(run, "path string, n int, class int, elements array<int>")


def common(m, n, least: float):
    """Elements that two sets of these sizes share at least, if they share ``least`` of their union."""
    return np.ceil(least / (1 + least) * (m + n) - 1e-6).astype(np.int64)


def needed(low: int, other: int, least: float) -> int:
    """Elements that have to be met in the prefixes, of classes whose least sizes are given; the same from both sides."""
    return max(1, min(max(LEAST, int(SHARE * max(low, other))), int(common(low, other, least))))


def prefix(n: int, low: int, s: int, least: float) -> int:
    """How many elements of a set of ``n`` are compared with sets of ``low`` or more."""
    return min(n, n - int(common(n, max(low, math.ceil(least * n - 1e-6)), least)) + s)


def _cells(t: DataFrame, side: int, sizes: dict, least: float) -> DataFrame:
    """Each set to the cells where it may meet a like one: (cell, side, path, n, need, elements). ``sizes`` has for (side, class) the least and greatest size and the parts."""

    def run(batches):
        rows, held = [], 0

        def out():
            cell, path, n, need, parts = zip(*rows)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            arrays = [pa.array(cell, pa.string()), pa.array([side] * len(rows), pa.int32()), pa.array(path, pa.string()), pa.array(n, pa.int32()), pa.array(need, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))]
            return pa.RecordBatch.from_arrays(arrays, ["cell", "side", "path", "n", "need", "elements"])

        others = [(k, *x) for (of, k), x in sizes.items() if of != side]
        seen = 0
        for batch in batches:
            values, offsets = _lists(batch.column(3))
            for i, (path, n, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                low, _, parts = sizes[side, own]
                seen += 1
                for k, least_n, most_n, n_parts in others:
                    if most_n < least * n - 1e-6 or least_n * least > n + 1e-6:
                        continue
                    s = needed(low, least_n, least)
                    elements = values[offsets[i] : offsets[i] + prefix(n, least_n, s, least)]
                    for p in range(n_parts):
                        # Left and right class, left and right part.
                        cell = (own, k, seen % parts, p) if side == 0 else (k, own, p, seen % parts)
                        rows.append(("{}.{}.{}.{}".format(*cell), path, n, s, elements))
                        held += len(elements)
                        if held > BATCH:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    return t.mapInArrow(run, "cell string, side int, path string, n int, need int, elements array<int>")


class _Index:
    """The right side's sets of a cell, by element."""

    def __init__(self, paths: list, sizes: list, lists: list):
        self.paths, self.n = paths, np.array(sizes, np.int64)
        self.prefix = np.array([len(x) for x in lists], np.int64)
        values = np.concatenate(lists)
        order = np.argsort(values, kind="stable")
        self.sets = np.repeat(np.arange(len(lists), dtype=np.int32), self.prefix)[order]
        values = values[order]
        self.starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        self.keys = values[self.starts]
        self.ends = np.append(self.starts[1:], len(values))

    def met(self, n: np.ndarray, values: np.ndarray, offsets: np.ndarray, need: int, least: float):
        """(rows, sets) that may be alike, of left sets of sizes ``n`` whose prefixes are given."""
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        hit = self.keys[at] == values
        lengths = np.where(hit, self.ends[at] - self.starts[at], 0)
        work = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        begin, own = 0, np.diff(offsets)
        while begin < len(n):
            # As many rows as make no more than a tile of postings and of counts, one at least.
            end = max(begin + 1, min(int(np.searchsorted(work, work[begin] + TILE, "right")) - 1, begin + max(1, TILE // len(self.n)), len(n)))
            span = slice(offsets[begin], offsets[end])
            size = lengths[span]
            total = int(size.sum())
            if total:
                shift = np.repeat(self.starts[at[span]] - (np.cumsum(size) - size), size)
                key = self.sets[shift + np.arange(total)].astype(np.int64)
                key += np.repeat(np.arange(end - begin) * len(self.n), np.diff(work[begin : end + 1]))
                counts = np.bincount(key, minlength=(end - begin) * len(self.n))
                found = np.flatnonzero(counts >= need)
                row, at_set = found // len(self.n) + begin, found % len(self.n)
                m, other = n[row], self.n[at_set]
                bound = np.minimum(own[row] - m, self.prefix[at_set] - other) + common(m, other, least)
                good = (counts[found] >= bound) & (np.minimum(m, other) >= least * np.maximum(m, other) - 1e-6)
                yield row[good], at_set[good]
            begin = end


def _meet(least: float):
    def run(batches):
        cell, held, index = None, ([], [], []), None
        for batch in batches:
            values, offsets = _lists(batch.column(5))
            names, sides, paths = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            n, need = batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy()
            begin = 0
            while begin < len(names):
                end = begin + 1
                while end < len(names) and names[end] == names[begin] and sides[end] == sides[begin]:
                    end += 1
                if names[begin] != cell:
                    cell, held, index = names[begin], ([], [], []), None
                if sides[begin] == 1:
                    held[0].extend(paths[begin:end])
                    held[1].extend(n[begin:end].tolist())
                    held[2].extend(values[offsets[i] : offsets[i + 1]].copy() for i in range(begin, end))
                elif held[0] or index:
                    if index is None:
                        index, held = _Index(*held), ([], [], [])
                    own = offsets[begin : end + 1]
                    for row, other in index.met(n[begin:end], values[own[0] : own[-1]], own - own[0], int(need[begin]), least):
                        if len(row):
                            yield pa.RecordBatch.from_arrays([pa.array([paths[begin + i] for i in row], pa.string()), pa.array([index.paths[j] for j in other], pa.string())], ["a", "b"])
                begin = end

    return run


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b), each pair once, of the paths of sets (path, hashes) that may share ``least`` of their union; none that does is left out. Sets without elements meet none."""
    from quillon.storage import keep

    spark = left.sparkSession
    levels = spark.sparkContext.broadcast(_levels(*(t.where(F.size("hashes") > 0) for t in (left, right))))
    sides = [keep(_ranked(t, levels), "ranked") for t in (left, right)]
    sizes = {}
    for side, t in enumerate(sides):
        for r in t.groupBy("class").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("all")).collect():
            # A prefix is less than half of a set, in the main.
            sizes[side, r["class"]] = (r.low, r.high, -(-r.all // (2 * BLOCK)))
    every = _cells(sides[0], 0, sizes, least).union(_cells(sides[1], 1, sizes, least))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return every.repartition(parts, "cell").sortWithinPartitions("cell", F.col("side").desc()).mapInArrow(_meet(least), "a string, b string")
