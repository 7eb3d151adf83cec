"""Near-duplicate documents by SimHash and a Gray-order hierarchical index.

Each document gets a 64-bit fingerprint: the bitwise majority over the hashes of its words
of at least ``min_bytes`` bytes, each as often as it occurs. Pairs within ``distance`` bits
are found without a comparison of all pairs: fingerprints are split into ``distance + k``
blocks, of which a pair within the distance must share k (pigeonhole), so each fingerprint
is sent once for each choice of k blocks, and each group is searched with the index. k grows with the
number of fingerprints, so that a group stays of a size for one task. There,
fingerprints are sorted by Gray rank; runs of the order become leaves and, level by level,
nodes. A node holds the mask of bits on which all below it agree and their pattern. Two nodes
differ by at least the bits in which their agreed patterns differ; a child only adds the bits
that its parent hadn't settled. Once the accumulated differences pass the distance, the whole
group is left out. The search is exact for the Hamming distance. Pairs of nodes are taken in runs of bounded size, and those
whose fingerprints are all in one component by then are left out, so a group of like fingerprints takes no more room than others.

Edge cases. Null texts, and texts without any word, have no fingerprint and are in no group.
A text whose words are all short uses all of its words. Equal texts are at distance 0. Rows
that repeat a doc_id are one document and get the fingerprint of the least; rows with a null
doc_id are ignored here and stay in :func:`drop_near_duplicates`. Empty tables give no rows.
Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import storage
from quillon.llm import textwords as tw

U64 = np.uint64
_LANES = U64(0x0101010101010101)
LEAF = 64
FANOUT = 8
#: Fingerprints of a group, about, beyond which groups are cut finer.
MOST_GROUP = 1_000_000
#: Pairs of nodes that are looked at together.
MOST_PAIRS = 1 << 18


def majority(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Majority bits of each run of ``hashes`` between the offsets ``first``, and whether the run holds any."""
    count = np.diff(first)
    out = np.zeros(len(count), U64)
    some = count > 0
    if not len(hashes):
        return out, some
    # Eight byte-wide counters share an integer, so a run is cut after 255 hashes and its parts are summed.
    parts = -(-count // 255)
    own = np.repeat(np.arange(len(count)), parts)
    cuts = first[own] + 255 * (np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts))
    sums = np.empty((len(cuts), 8), U64)
    for i in range(8):
        sums[:, i] = np.add.reduceat((hashes >> U64(i)) & _LANES, cuts)
    heads = np.flatnonzero(np.diff(own, prepend=-1))
    ones = np.add.reduceat(sums.view(np.uint8).astype(np.int32), heads, axis=0)
    out[some] = np.packbits(2 * ones > count[some][:, None], axis=1).view(U64).ravel()
    return out, some


def fingerprint_batch(texts: pa.Array, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a string column and which rows have one."""
    prints, has = np.zeros(len(texts), U64), np.zeros(len(texts), bool)
    for at, w in tw.split(texts):
        long = (w.end - w.start) >= min_bytes
        doc = w.doc()
        kept = np.bincount(doc[long], minlength=len(w.first) - 1)
        long |= (kept == 0)[doc]
        first = np.concatenate([[0], np.cumsum(long)])[w.first]
        till = at + len(w.first) - 1
        prints[at:till], has[at:till] = majority(w.hash[long], first)
    return prints, has


def fingerprints(docs: DataFrame, min_bytes: int = 5) -> DataFrame:
    """(doc_id, fp) of the documents that have a fingerprint; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, has = fingerprint_batch(batch.column(1), min_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(has)), pa.array(prints[has].view(np.int64))], names=["doc_id", "fp"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U64(s)
    return rank


class GrayIndex:
    """The hierarchical index over distinct fingerprints; ``levels[0]`` are the leaves, the last is the root."""

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        every, some = self.codes, self.codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = LEAF
        while True:
            cuts = np.arange(0, len(every), size)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            self.levels.append((~(every ^ some), every))
            if len(every) == 1:
                break
            size = FANOUT
        self.tiles = np.append(self.codes, np.zeros(LEAF, U64))

    def near(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of positions (in the order given to the index) within ``distance``, each once."""
        found = [*self.walk(distance), (np.zeros(0, np.int64),) * 2]
        p, q = (np.concatenate(x) for x in zip(*found))
        return self.order[p], self.order[q]

    def walk(self, distance: int, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in Gray order within ``distance``, run by run, with at most MOST_PAIRS pairs of nodes looked at together.

        With ``root``, which the caller keeps up to date, pairs of nodes that lie in one component are left out.
        """
        kids = np.arange(FANOUT)
        one = np.zeros(1, np.int64)
        todo = [(len(self.levels) - 1, one, one, one, np.zeros(1, U64))]
        step, since = 64, 0
        spans = None if root is None else self.spans(root)
        while todo:
            k, a, b, gone, settled = todo.pop()
            mask, pattern = self.levels[k]
            fresh = mask[a] & mask[b] & ~settled
            gone = gone + np.bitwise_count((pattern[a] ^ pattern[b]) & fresh)
            live = gone <= distance
            if spans:
                live &= apart(spans[k], a, b)
            a, b, gone, settled = a[live], b[live], gone[live], (settled | fresh)[live]
            if not k:
                near = np.argsort(b - a, kind="stable")
                a, b = a[near], b[near]
                while len(a):
                    yield self.leaves(a[:step], b[:step], distance)
                    a, b, since = a[step:], b[step:], since + min(step, len(a)) * LEAF**2
                    # New roots of the nodes are worth it after some comparisons for each fingerprint.
                    if spans and since >= 4 * len(self.codes):
                        spans, since = self.spans(root), 0
                        live = apart(spans[0], a, b)
                        a, b = a[live], b[live]
                continue
            below = len(self.levels[k - 1][0])
            most = max(1, MOST_PAIRS // FANOUT**2)
            # Neighbours in the order are the likeliest to be near: they come first.
            first = np.argsort(b - a, kind="stable")
            cuts = range(0, len(a), most)
            for i in reversed(cuts):
                take = first[i : i + most]
                x = (a[take][:, None] * FANOUT + kids)[:, :, None]
                y = (b[take][:, None] * FANOUT + kids)[:, None, :]
                ok = (x <= y) & (x < below) & (y < below)
                x, y = np.broadcast_arrays(x, y)
                n = ok.reshape(len(take), -1).sum(axis=1)
                todo.append((k - 1, x[ok], y[ok], np.repeat(gone[take], n), np.repeat(settled[take], n)))

    def spans(self, root: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and the largest root below each node, level by level."""
        low, high, out, size = root, root, [], LEAF
        for _ in self.levels:
            cuts = np.arange(0, len(low), size)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append((low, high))
            size = FANOUT
        return out

    def leaves(self, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places within ``distance``, the first in the leaves a, the second in the leaves b."""
        x, y = (z[:, None] * LEAF + np.arange(LEAF) for z in (a, b))
        t, p, q = np.nonzero(np.bitwise_count(self.tiles[x][:, :, None] ^ self.tiles[y][:, None, :]) <= distance)
        p, q = x[t, p], y[t, q]
        ok = (p < q) & (q < len(self.codes))
        return p[ok], q[ok]

    def forest(self, distance: int) -> np.ndarray:
        """The least position of each position's component under the pairs within ``distance``; pairs go as soon as they are joined."""
        root = np.arange(len(self.codes))
        for p, q in self.walk(distance, root):
            if len(p):
                forest(root, p, q)
        # Places in Gray order, as positions in the order given: the least of each component.
        least = np.full(len(root), len(root))
        np.minimum.at(least, root, self.order)
        out = np.empty(len(root), np.int64)
        out[self.order] = least[root]
        return out


def apart(spans: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the nodes a and b hold more than one component together, by the least and largest roots below each."""
    low, high = spans
    return (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of ``root``, the least place of each, along the pairs (a, b)."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root[:] = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]


def blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` blocks that cover 64 bits."""
    ends = np.linspace(0, 64, n + 1).round().astype(int)
    return [(int(s), int(e - s)) for s, e in zip(ends[:-1], ends[1:])]


def agreeing(n: int, distance: int) -> int:
    """How many of ``distance`` plus as many blocks must agree so that a group of ``n`` even fingerprints has MOST_GROUP at most."""
    agree = 1
    while n >> (64 * agree // (distance + agree)) > MOST_GROUP and agree < 8:
        agree += 1
    return agree


def near_edges(prints: DataFrame, distance: int, agree: int = 1) -> DataFrame:
    """Edges (a, b) of fingerprints that connect just those that chains of pairs within ``distance`` connect.

    ``prints`` has distinct fp. A pair within the distance agrees on ``agree`` of the ``distance + agree`` blocks, whatever
    ``agree`` is; the more it is, the more and the smaller are the groups. Of each group only a spanning forest
    leaves the search, so the edges stay in proportion to the fingerprints however many pairs there are.
    """
    keys = []
    for i, chosen in enumerate(combinations(blocks(distance + agree), agree)):
        key = F.lit(i).cast("long")
        for s, w in chosen:
            key = F.shiftleft(key, w).bitwiseOR(F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1))
        keys.append(key)

    def search(table: pa.Table) -> pa.Table:
        codes = table.column("fp").to_numpy().view(U64)
        root = GrayIndex(codes).forest(distance)
        moved = np.flatnonzero(root != np.arange(len(codes)))
        return pa.table({"a": codes[moved].view(np.int64), "b": codes[root[moved]].view(np.int64)})

    return prints.select("fp", F.explode(F.array(*keys)).alias("block")).groupBy("block").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 8, min_bytes: int = 5) -> DataFrame:
    """(doc_id, duplicate_of, distance): each document of a group but the one with the least doc_id, which ``duplicate_of`` names.

    ``distance`` in the result is that between the two fingerprints; along a chain it can exceed the bound.
    """
    storage.lean(docs.sparkSession)
    prints = storage.keep(fingerprints(docs, min_bytes).groupBy("doc_id").agg(F.min("fp").alias("fp")), "prints")
    edges = near_edges(prints.select("fp").distinct(), distance, agreeing(prints.count(), distance))
    roots = storage.components(edges).withColumnsRenamed({"node": "fp"})
    grouped = prints.join(roots, "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("grp"))
    kept = grouped.groupBy("grp").agg(F.min_by("fp", "doc_id").alias("kept_fp"), F.min("doc_id").alias("duplicate_of"), F.count("*").alias("n")).where("n > 1")
    return (
        grouped.join(kept, "grp")
        .where("doc_id <> duplicate_of")
        .select("doc_id", "duplicate_of", F.bit_count(F.col("fp").bitwiseXOR(F.col("kept_fp"))).alias("distance"))
    )


def drop_near_duplicates(docs: DataFrame, distance: int = 8, min_bytes: int = 5) -> DataFrame:
    """``docs`` with one document of each group, that with the least doc_id, and all that are in none."""
    gone = storage.keep(near_duplicates(docs, distance, min_bytes).select(F.col("doc_id").alias("__gone")), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
