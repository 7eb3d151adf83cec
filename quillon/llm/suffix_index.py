"""Suffix-array dedup with a logarithmic family of indexes.

The text is a sequence of words, each a byte-sized hash. Not every suffix is indexed: of any
``LEFT + 1`` neighbouring positions that with the least hash of its next words is (a sparse suffix
array on content-defined positions, about one word in ten). Two equal runs of at least
``CORE + LEFT`` words have an indexed suffix at the same place among their first LEFT + 1 words, with CORE
equal words to follow, so none is missed. A suffix is held as its CORE words, the LEFT before them in
reverse and the LEFT after them; two arrays order the suffixes, by core and then what precedes, and by
core and then what follows, so neighbours in the one share most to the left and in the other to the right.

Documents arrive in ``batches``. A batch's suffixes are sorted into a suffix array, which is
merge-scanned against the levels that exist: where a suffix would stand in a level, its neighbours
share the most with it. A suffix that agrees with one on its core is a match, widened to either
side as far as the neighbour in that order agrees. Matches within the batch are found likewise, against the
earlier of equal suffixes. Then the batch becomes a level of its own, and while the last two levels hold as many
batches, they merge, so there are never more than log2 of the batches. Suffixes that are equal in full
are held once, by their first occurrence: thousands of copies take the room of one.

Suffixes are partitioned by their core, which all that could match share. Each partition
keeps its own family, so the one shuffle is that of the suffixes. Of suffixes that are equal in full, only the first of a batch of rows
is shuffled as such: the others' matches with it are known there and then, so a hot run is thinned before it meets in one task.
:class:`Index` keeps the families' levels as a table in the shared folder, to which new batches are appended at any time. Matches of a document that
touch or overlap are joined; those of at least ``min_words`` words together are the result. So every
run of that many words that occurred before lies in a result; a result can also join runs of CORE
words or more that occurred in different places.

Edge cases. Documents of fewer than CORE + LEFT words have no match, nor have null and empty ones.
Rows with a null doc_id take no part. Repeated rows of a doc_id count as one document with its text; rows of one doc_id with
different texts are texts of one document. The same run twice in one document is a match with itself, at its later place. Ties in the order of
arrival go to the smaller doc_id, then the smaller position. Empty tables give no rows. Byte-sized hashes can
widen a match by a word by chance (1 in 255); that a core agrees by chance is out of question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import storage
from quillon.llm import textwords as tw

U64 = np.uint64
CORE, LEFT = 32, 18
SHORTEST = CORE + LEFT
WIDTH = CORE + 2 * LEFT
_GRAM = 6


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def sampled(w: tw.Words) -> np.ndarray:
    """The word positions whose suffixes are indexed: least of LEFT + 1 neighbours, all of which have CORE words to follow."""
    n = len(w.hash)
    if n < SHORTEST:
        return np.zeros(0, np.int64)
    room = tw.room(w.first)
    value = np.full(n, ~U64(0))
    grams = tw.ngrams(w.hash, _GRAM)
    value[: len(grams)] = grams | U64(1)
    width = LEFT + 1
    # least[q] is that of the window from q; windows must lie within a document and its last CORE - 1 words are no suffix.
    least = _sliding(value, width, np.minimum)
    least = np.where(room[: len(least)] >= SHORTEST, least, U64(0))
    spread = np.zeros(n + width - 1, U64)
    spread[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero(_sliding(spread, width, np.maximum)[:n] == value)


def suffixes(w: tw.Words, at: np.ndarray) -> np.ndarray:
    """A row for each position: the bytes of its core, of the LEFT words before in reverse, of the LEFT after; 0 beyond the document."""
    small = np.zeros(len(w.hash) + WIDTH, np.uint8)
    small[LEFT : LEFT + len(w.hash)] = ((w.hash >> U64(40)) % U64(255)).astype(np.uint8) + np.uint8(1)
    rows = np.lib.stride_tricks.sliding_window_view(small, WIDTH)[at]
    doc = np.searchsorted(w.first, at, side="right") - 1
    before, after = at - w.first[doc], w.first[doc + 1] - at - CORE
    left = rows[:, :LEFT][:, ::-1] * (np.arange(LEFT) < before[:, None])
    right = rows[:, SHORTEST:] * (np.arange(LEFT) < after[:, None])
    return np.concatenate([rows[:, LEFT:SHORTEST], left, right], axis=1)


_TABLE = "doc_id long, position int, batch int, suffix binary, start_word long, end_word long, match_doc_id long"
_NAMES = ["doc_id", "position", "batch", "suffix", "start_word", "end_word", "match_doc_id"]


def order_of(keys: np.ndarray, *ranks: np.ndarray) -> np.ndarray:
    """The order by key, then by the ranks."""
    order = np.lexsort(ranks[::-1])
    return order[np.argsort(keys[order], kind="stable")]


def suffix_table(docs: DataFrame, batches: int = 1) -> DataFrame:
    """The indexed suffixes of all documents, with the number of the batch in which each document arrives.

    Of equal ones in a batch of rows the first stands as such; each other has a null suffix and its match with that one.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            docs_of, arrivals = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            parts = []
            for first, w in tw.split(batch.column(1)):
                at = sampled(w)
                own = np.searchsorted(w.first, at, side="right") - 1
                parts.append((docs_of[first + own], at - w.first[own], arrivals[first + own], suffixes(w, at)))
            if not sum(len(x[0]) for x in parts):
                continue
            doc, position, arrival, rows = (np.concatenate(x) for x in zip(*parts))
            keys = np.ascontiguousarray(rows).view(f"S{WIDTH}").ravel()
            order = order_of(keys, arrival, doc, position)
            doc, position, arrival, rows, keys = doc[order], position[order], arrival[order], rows[order], keys[order]
            heads = np.ones(len(doc), bool)
            heads[1:] = keys[1:] != keys[:-1]
            leader = np.flatnonzero(heads)[np.cumsum(heads) - 1]
            # A repeated row of a document isn't a repeat.
            again = np.zeros(len(doc), bool)
            again[1:] = ~heads[1:] & (doc[1:] == doc[:-1]) & (position[1:] == position[:-1])
            rest = np.flatnonzero(~heads & ~again)
            yield pa.RecordBatch.from_arrays([pa.array(doc[heads]), pa.array(position[heads].astype(np.int32)), pa.array(arrival[heads].astype(np.int32)), tw.binary(rows[heads]), *(pa.nulls(int(heads.sum()), pa.int64()) for _ in range(3))], names=_NAMES)
            if len(rest):
                left, right = (np.where((z == 0).any(axis=1), (z == 0).argmax(axis=1), LEFT) for z in (rows[rest, CORE:SHORTEST], rows[rest, SHORTEST:]))
                spans = position[rest] - left, position[rest] + CORE + right, doc[leader[rest]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[rest]), pa.array(position[rest].astype(np.int32)), pa.array(arrival[rest].astype(np.int32)), pa.nulls(len(rest), pa.binary()), *map(pa.array, spans)], names=_NAMES)

    storage.lean(docs.sparkSession)
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", arrival.alias("batch")).mapInArrow(run, _TABLE)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of leading bytes that rows of a and b share; what lies beyond a document is shared with nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class Level:
    """A suffix array: rows in order, with the document and position of each one's first occurrence, and how many batches it holds."""

    def __init__(self, rows: np.ndarray, doc: np.ndarray, position: np.ndarray, batches: int) -> None:
        self.rows, self.doc, self.position, self.batches = rows, doc, position, batches
        self.keys = np.ascontiguousarray(rows).view(f"S{WIDTH}").ravel()


def distinct(rows: np.ndarray, doc: np.ndarray, position: np.ndarray, rank: np.ndarray, batches: int) -> Level:
    """Sorts suffixes and keeps of equal ones that of the least rank."""
    keys = np.ascontiguousarray(rows).view(f"S{WIDTH}").ravel()
    order = np.argsort(rank, kind="stable")
    order = order[np.argsort(keys[order], kind="stable")]
    keep = np.ones(len(order), bool)
    keep[1:] = keys[order[1:]] != keys[order[:-1]]
    order = order[keep]
    return Level(rows[order], doc[order], position[order], batches)


def scan(level: Level, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (sorted) suffix, the row of the level that shares the most with it, and how many bytes they share."""
    if not len(level.keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    at = np.searchsorted(level.keys, keys)
    above, below = np.maximum(at - 1, 0), np.minimum(at, len(level.keys) - 1)
    up, down = common(level.rows[above], rows), common(level.rows[below], rows)
    return np.where(down >= up, below, above), np.maximum(up, down)


class Family:
    """Levels of suffix arrays in one order; their sizes, in batches, are falling powers of two."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, doc: np.ndarray, position: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scans a new batch, then takes it in: (doc, position, bytes shared, other doc) of the suffixes that share a core."""
        keys = np.ascontiguousarray(rows).view(f"S{WIDTH}").ravel()
        order = order_of(keys, doc, position)
        same = np.zeros(len(order), bool)
        same[1:] = (keys[order[1:]] == keys[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (position[order[1:]] == position[order[:-1]])
        order = order[~same]
        doc, position, rows, keys = doc[order], position[order], rows[order], keys[order]
        n = len(doc)
        shared, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for level in self.levels:
            row, m = scan(level, keys, rows)
            better = m > shared
            shared[better], other[better] = m[better], level.doc[row[better]]
        if n > 1:
            # Suffixes of one core are led by the least document and position, which isn't a repeat of the others.
            near = common(rows[1:], rows[:-1])
            heads = np.concatenate([[True], near < CORE])
            run = np.cumsum(heads) - 1
            leader = np.lexsort((position, doc, run))[np.flatnonzero(heads)]
            widest = np.maximum(np.concatenate([[0], near]), np.concatenate([near, [0]]))
            take = (widest >= CORE) & (widest > shared)
            take[leader] = False
            shared[take], other[take] = widest[take], doc[leader[run[take]]]
        if n:
            self.levels.append(distinct(rows, doc, position, np.arange(n), 1))
            while len(self.levels) > 1 and self.levels[-1].batches >= self.levels[-2].batches:
                new, old = self.levels.pop(), self.levels.pop()
                rank = np.concatenate([np.zeros(len(old.doc), np.int8), np.ones(len(new.doc), np.int8)])
                self.levels.append(distinct(np.concatenate([old.rows, new.rows]), np.concatenate([old.doc, new.doc]), np.concatenate([old.position, new.position]), rank, old.batches + new.batches))
        hit = shared >= CORE
        return doc[hit], position[hit], shared[hit], other[hit]


#: The order of a row's bytes in which what follows the core comes before what precedes it.
_RIGHT_FIRST = np.r_[0:CORE, SHORTEST:WIDTH, CORE:SHORTEST]


def families(table: DataFrame, batches: int, levels: DataFrame | None = None, keep_levels: bool = False) -> DataFrame:
    """Matches of the suffixes' batches with each other and with the stored ``levels``, which the families go on from.

    With ``keep_levels`` the families' levels come after the matches, as rows with a suffix: ``batch`` says how many batches a row's level
    holds and ``end_word`` which level it is.
    """
    t = table.select(*_NAMES, F.lit(-1).alias("level"))
    if levels is not None:
        t = t.unionByName(levels)
    # Matches that are known already go through wherever they are.
    parts = t.repartition(F.coalesce(F.substring("suffix", 1, CORE), F.encode(F.col("doc_id").cast("string"), "UTF-8")))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for x in stream:
            known = pc.is_null(x.column(3))
            done = x.filter(known)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays(done.columns[:7], names=_NAMES)
            held.append(x.filter(pc.invert(known)))
        if not sum(x.num_rows for x in held):
            return
        t = pa.Table.from_batches(held)
        del held
        doc, position, batch, level = (t.column(c).to_numpy() for c in ("doc_id", "position", "batch", "level"))
        position = position.astype(np.int64)
        rows = tw.matrix(t.column("suffix"), WIDTH)
        del t
        by_left, by_right = Family(), Family()
        for k in np.unique(level[level >= 0]):
            own = np.flatnonzero(level == k)
            for family, order in ((by_left, slice(None)), (by_right, _RIGHT_FIRST)):
                family.levels.append(distinct(rows[own][:, order], doc[own], position[own], np.arange(len(own)), int(batch[own[0]])))
        for b in range(batches):
            own = np.flatnonzero((batch == b) & (level < 0))
            args = doc[own], position[own]
            d, p, n, other = by_left.add(*args, rows[own])
            yield _spans(d, p - np.minimum(n - CORE, LEFT), p + CORE + np.maximum(n - SHORTEST, 0), other)
            d, p, n, other = by_right.add(*args, rows[own][:, _RIGHT_FIRST])
            yield _spans(d, p - np.maximum(n - SHORTEST, 0), p + np.minimum(n, SHORTEST), other)
        if keep_levels:
            for k, x in enumerate(by_left.levels):
                n = len(x.doc)
                yield pa.RecordBatch.from_arrays([pa.array(x.doc), pa.array(x.position.astype(np.int32)), pa.array(np.full(n, x.batches, np.int32)), tw.binary(x.rows), pa.nulls(n, pa.int64()), pa.array(np.full(n, k, np.int64)), pa.nulls(n, pa.int64())], names=_NAMES)

    return parts.mapInArrow(run, _TABLE)


def matches(table: DataFrame, batches: int) -> DataFrame:
    """(doc_id, start_word, end_word, match_doc_id) for each suffix, by families of indexes of each partition of the suffixes."""
    return families(table, batches).select("doc_id", "start_word", "end_word", "match_doc_id")


class Index:
    """A stored family of levels: what is appended is matched with all that came before it, and then part of it.

    The levels are a table in the shared folder, written anew by each append with the matches; the one before is dropped then, so an
    append that fails leaves the index as it was. A partition's levels double: an append rewrites a level once for each doubling.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.levels, self._kept = spark, None, None

    def append(self, docs: DataFrame, batches: int = 1, min_words: int = SHORTEST) -> DataFrame:
        """As :func:`long_matches`, of ``docs`` with what was appended before and with each other; ``docs`` arrives in so many batches."""
        kept = storage.keep(families(suffix_table(docs, batches), batches, self.levels, True), "levels")
        found = storage.keep(joined(kept.where("suffix IS NULL"), min_words), "matches")
        levels = kept.where("suffix IS NOT NULL").select("doc_id", "position", "batch", "suffix", *(F.lit(None).cast("long").alias(c) for c in _NAMES[4:]), F.col("end_word").cast("int").alias("level"))
        before, self.levels, self._kept = self._kept, levels, kept
        if before is not None:
            storage.drop(before)
        return found


def _spans(*columns: np.ndarray) -> pa.RecordBatch:
    doc, start, end, other = columns
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *map(pa.array, (start, end, other))], names=_NAMES)


def long_matches(docs: DataFrame, batches: int = 8, min_words: int = SHORTEST) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, match_doc_id): maximal runs of words that occurred before, of ``min_words`` at least.

    ``match_doc_id`` names the document of the first of the joined matches that reaches furthest to the left.
    """
    return joined(matches(suffix_table(docs, batches), batches), min_words)


def joined(found: DataFrame, min_words: int) -> DataFrame:
    """The maximal runs that matches of suffixes make up together."""
    by_doc = Window.partitionBy("doc_id").orderBy("start_word", "end_word", "match_doc_id")
    reach = F.max("end_word").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("fresh", F.when(F.coalesce(reach, F.lit(-1)) < F.col("start_word"), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc_id", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min_by("match_doc_id", F.struct("start_word", "end_word", "match_doc_id")).alias("match_doc_id"))
    return out.where(F.col("end_word") - F.col("start_word") >= min_words).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "match_doc_id")
