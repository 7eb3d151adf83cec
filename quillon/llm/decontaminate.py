"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

The alphabet is words. A test item of m words may be found with up to ``floor(m * rate)`` word
edits. It is split into that budget plus one pieces; in any occurrence within the budget at
least one piece is intact, so exact hits of pieces are all candidates there are. Pieces are
looked up by a rolling hash at every word of every document; each hit names the place where
the item would lie, and there Myers' algorithm (bit vectors of any length, free ends in the
text) gives the least edit distance and where the match ends. The search is exact for this
distance, over whole texts, and reads the documents once without a shuffle: the pieces are
broadcast, in parts of about ``most_pieces``. The driver compiles and a worker holds one part at a time,
with one pass over each batch for each part.

Edge cases. Items of few words have a budget of no edits and are found where they stand as they are; those
without words, and null ids and texts, are left out. ``min_words``, 1 unless it is set, leaves shorter items out. Items that repeat are each reported; repeated rows of a document
are each searched. Null and empty documents match nothing. Two matches of an item in a document
count once, with the least distance and then the first place. An empty benchmark matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import storage
from quillon.llm import textwords as tw

U64 = np.uint64
_FILTER_BITS = 20


def budget(m: int, rate: float) -> int:
    """Word edits allowed in an item of m words."""
    return int(m * rate + 1e-9)


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a substring of ``text``, where the first such substring ends)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, x in enumerate(pattern.tolist()):
        peq[x] = peq.get(x, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, x in enumerate(text.tolist()):
        eq = peq.get(x, 0)
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh, xv = (ph << 1) & full, (mh << 1) & full, eq | mv
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Pieces:
    """The pieces of some items, by hash."""

    def __init__(self, ids: list[int], items: list[np.ndarray], rate: float) -> None:
        self.ids, self.items, self.rate = ids, items, rate
        rows = []
        for k, words in enumerate(items):
            cuts = np.linspace(0, len(words), budget(len(words), rate) + 2).round().astype(int)
            rows += [(b - a, int(tw.ngrams(words[a:b], b - a)[0]), k, a) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]
        self.lengths = []
        for n in sorted({r[0] for r in rows}):
            mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == n)
            hashes = np.array([r[0] for r in mine], U64)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> U64(64 - _FILTER_BITS)] = True
            self.lengths.append((n, hashes, np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), seen))

    def search(self, w: tw.Words) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, first word, end word) of the matches within the budget; one of each document and item."""
        room, doc_of = None, None
        places: set[tuple[int, int, int]] = set()
        for n, hashes, item, start, seen in self.lengths:
            grams = tw.ngrams(w.hash, n)
            at = np.flatnonzero(seen[grams >> U64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(hashes, grams[at]), np.searchsorted(hashes, grams[at], side="right")
            hit = high > low
            if not hit.any():
                continue
            if room is None:
                room, doc_of = tw.room(w.first), w.doc()
            at, low, high = at[hit], low[hit], high[hit]
            inside = room[at] >= n
            for p, a, b in zip(at[inside].tolist(), low[inside].tolist(), high[inside].tolist()):
                places.update((int(doc_of[p]), int(item[r]), p - int(start[r])) for r in range(a, b))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for doc, k, at in sorted(places):
            pattern = self.items[k]
            m, e = len(pattern), budget(len(pattern), self.rate)
            # An intact piece may be shifted by as many words as the budget.
            if done.get((doc, k)) == at:
                continue
            done[doc, k] = at
            first, end = int(w.first[doc]), int(w.first[doc + 1])
            low, high = max(first, at - e), min(end, at + m + e)
            distance, till = myers(pattern, w.hash[low:high])
            if distance > e:
                continue
            # The match reversed gives its start.
            back = myers(pattern[::-1], w.hash[low : low + till][::-1])[1]
            found = (distance, low + till - back - first, low + till - first)
            if (doc, k) not in best or found < best[doc, k]:
                best[doc, k] = found
        return [(doc, k, *found) for (doc, k), found in best.items()]


def compiled(benchmark: DataFrame, rate: float, min_words: int, most_pieces: int) -> Iterator[Pieces]:
    """The benchmark's items as pieces, part by part, as the driver reads them."""
    ids: list[int] = []
    items: list[np.ndarray] = []
    pieces = 0
    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = tw.words(*tw.buffers(pa.array([row[1]]))).hash
        if len(words) < max(1, min_words):
            continue
        ids.append(row[0])
        items.append(words)
        pieces += budget(len(words), rate) + 1
        if pieces >= most_pieces:
            yield Pieces(ids, items, rate)
            ids, items, pieces = [], [], 0
    if ids:
        yield Pieces(ids, items, rate)


def _search(parts: list, texts: pa.Array) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    rows, items, distances, starts, ends = [], [], [], [], []
    for part in storage.each(parts):
        for at, w in tw.split(texts):
            for doc, k, distance, start, end in part.search(w):
                rows.append(at + doc)
                items.append(part.ids[k])
                distances.append(distance)
                starts.append(start)
                ends.append(end)
    return rows, items, distances, starts, ends


def _sent(docs: DataFrame, benchmark: DataFrame, rate: float, min_words: int, most_pieces: int) -> list:
    spark = docs.sparkSession
    storage.lean(spark)
    return [spark.sparkContext.broadcast(p) for p in compiled(benchmark, rate, min_words, most_pieces)]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_words: int = 1, most_pieces: int = 500_000) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word): the test items that each document holds within the budget."""
    parts = _sent(docs, benchmark, rate, min_words, most_pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, *columns = _search(parts, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "item_id", "distance", "start_word", "end_word"])

    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, distance long, start_word long, end_word long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_words: int = 1, most_pieces: int = 500_000) -> DataFrame:
    """``docs`` without the documents that hold a test item; one pass over the texts, no join, nothing else changed."""
    parts = _sent(docs, benchmark, rate, min_words, most_pieces)

    @F.arrow_udf(T.BooleanType())
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        out[_search(parts, texts)[0]] = False
        return pa.array(out)

    return docs.where(clean("text"))
