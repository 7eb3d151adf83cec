"""Substring dedup by paragraph MinHash banding.

Texts are cut into natural paragraphs, which are lines, where a run of lines of fewer than ``reach``
words each is one; and these into pieces: after each word whose hash with its predecessor's is the
least of the ``reach`` words around it, but not where that would leave a short remainder at either
end. Such cuts depend only on the words near them, so a passage pasted anywhere is cut alike wherever
it occurs. With ``natural``, as in the query and the pipeline, natural paragraphs of several pieces are
compared whole too: a few changed words leave most of a paragraph's trigrams as they are, but few of
its pieces'. Each paragraph's set of word trigrams (of all its words where there are fewer) gets MinHash values;
they are banded so that pairs at the similarity threshold collide with the wanted recall
(:func:`tune_bands`). Equal paragraphs share an id from the start, so copies by the thousand cost one candidate.

One aggregation over band keys and ids says which keys several paragraphs share, with partial minima and maxima, so
no group is gathered; only what a sieve of those keys lets through is read again. Of each band, all are first compared with
the least id by exact Jaccard of the trigram sets, and components are formed. Only those that this leaves outside the
least one's component are then compared with the rest of their band that is in another component. Bands of more than ``PLAIN`` members are many unlike
paragraphs that share some common trigrams; there only pairs are compared that share one of their rarest trigrams in the band, which any similar
pair does (:func:`_rare`), and as long as many pairs are left, rounds of one pair a component come first (:data:`MANY`). So a template with a million variants costs about a million comparisons, and no link between different paragraphs that share a band is lost.
Verified pairs form components; of each component the first paragraph, by doc_id and position, stays and later ones are repeats.
Repeats are removed where they stand in runs of ``min_run`` words at least: a stock line of a few words is no passage.

Edge cases. A paragraph of fewer than ``min_words`` words, which stands alone between longer lines, is never removed. Null and empty texts
have no paragraphs. Rows with a null doc_id take no part. Repeated rows of one doc_id are the same paragraphs, not repeats; rows of
one doc_id with different texts are different documents, ordered by their texts' hashes. Ties in doc_id and position can't
occur otherwise. Empty tables give no rows. Other columns are kept as they are, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import sieve, storage
from quillon.llm import textwords as tw

U64 = np.uint64
_SHINGLE = 3


def tune_bands(threshold: float, recall: float, most_bands: int) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance collisions, for which a pair at the threshold collides with the wanted recall."""
    best = (max(1, int(np.ceil(np.log(1 - recall) / np.log(max(1 - threshold, 1e-12))))), 1)
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands <= most_bands:
            best = (bands, rows)
    return best


def spans(w: tw.Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words from each start to its end."""
    total = np.zeros(len(w.hash) + 1, U64)
    tw._tables.need(len(total) + 1)
    np.cumsum(w.hash * tw._tables.up[: len(w.hash)], out=total[1:])
    return tw.mix((total[ends] - total[starts]) * tw._tables.down[starts] + (ends - starts).astype(U64))


class Paragraphs:
    """The paragraphs of a run of documents: word ranges, their documents, positions within them, and byte ranges."""

    def __init__(self, w: tw.Words, reach: int, min_words: int, natural: bool = False) -> None:
        n = len(w.hash)
        line = np.zeros(n + 1, bool)
        line[w.first] = True
        if n:
            line[np.searchsorted(w.start, np.flatnonzero(w.data == 10))] = True
        # Natural paragraphs: lines, and runs of lines of fewer than ``reach`` words as one.
        lines = np.flatnonzero(line[:-1])
        short = np.diff(np.append(lines, n)) < reach
        joined = np.zeros(len(lines), bool)
        joined[1:] = short[1:] & short[:-1]
        head = np.zeros(n + 1, bool)
        head[w.first] = True
        opens = lines[~joined | head[lines]]
        closes = np.append(opens[1:], n)[: len(opens)]
        cut = np.zeros(n + 1, bool)
        cut[opens] = True
        if n:
            pair = w.hash.copy()
            pair[1:] ^= tw.mix(w.hash[:-1])
            heads = w.first[:-1][np.diff(w.first) > 0]
            pair[heads] = w.hash[heads]
            pair = tw.mix(pair)
            # ``reach`` places between documents keep their windows apart.
            at = np.arange(n) + reach * (w.doc() + 1)
            least = np.full(n + reach * (len(w.first) + 1), ~U64(0))
            least[at] = pair
            size = 1
            while 2 * size <= 2 * reach + 1:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            rest = 2 * reach + 1 - size
            least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
            # A cut comes after the word that is the least, but leaves no remainder at either end of a natural
            # paragraph, where words outside it would decide.
            after = np.flatnonzero(pair == least[at - reach]) + 1
            own = np.searchsorted(opens, after - 1, side="right") - 1
            cut[after[(after - opens[own] >= reach + 2) & (closes[own] - after >= reach)]] = True
        self.starts = np.flatnonzero(cut[:-1])
        self.ends = np.append(self.starts[1:], n)[: len(self.starts)]
        self.doc = np.searchsorted(w.first, self.starts, side="right") - 1
        self.position = np.arange(len(self.starts)) - np.searchsorted(self.doc, self.doc)
        # How many pieces a natural paragraph has; 0 for the pieces of those that have several.
        first = np.searchsorted(self.starts, opens)
        count = np.diff(np.append(first, len(self.starts)))
        self.pieces = np.repeat((count == 1).astype(np.int64), count)
        if natural:
            whole = np.flatnonzero(count > 1)
            self.starts, self.ends = np.append(self.starts, opens[whole]), np.append(self.ends, closes[whole])
            self.doc, self.position = np.append(self.doc, self.doc[first[whole]]), np.append(self.position, self.position[first[whole]])
            self.pieces = np.append(self.pieces, count[whole])
        keep = self.ends - self.starts >= min_words
        self.starts, self.ends, self.doc, self.position, self.pieces = self.starts[keep], self.ends[keep], self.doc[keep], self.position[keep], self.pieces[keep]
        self.words = w

    def ids(self) -> np.ndarray:
        """A hash of each paragraph's words in their order."""
        return spans(self.words, self.starts, self.ends)

    def texts(self) -> np.ndarray:
        """For each paragraph a hash of all words of its document."""
        return spans(self.words, self.words.first[:-1], self.words.first[1:])[self.doc]

    def sets(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigram hashes of the chosen paragraphs in rising order, one after another, and their offsets."""
        grams, first = self.shingles()
        count = np.diff(first)[chosen]
        own = np.repeat(np.arange(len(chosen)), count)
        at = np.arange(len(own)) + np.repeat(first[chosen] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(chosen) else 0, count)
        g = grams[at.astype(np.int64)]
        order = np.lexsort((g, own))
        g, own = g[order], own[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
        return g[new], np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(chosen)))])

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Trigram hashes of all paragraphs, one after another, and their offsets."""
        grams = tw.ngrams(self.words.hash, _SHINGLE)
        count = np.maximum(self.ends - self.starts - _SHINGLE + 1, 0)
        first = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(first[-1]) + np.repeat(self.starts - first[:-1], count)
        return grams[at], first

    def minhashes(self, n: int) -> np.ndarray:
        """The n least permuted trigram hashes of each paragraph, as 32 bits."""
        grams, first = self.shingles()
        rng = np.random.default_rng(20240229)
        odd, add = rng.integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)
        out = np.empty((len(self.starts), n), np.uint32)
        for k in range(n):
            out[:, k] = np.minimum.reduceat(((grams * odd[k] + add[k]) >> U64(32)).astype(np.uint32), first[:-1]) if len(grams) else 0
        return out


def _batches(docs: DataFrame):
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")


def _bands(p: Paragraphs, chosen: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band keys of the chosen paragraphs, a column a band."""
    mins = p.minhashes(bands * rows)[chosen].astype(U64)
    out = np.empty((len(chosen), bands), U64)
    for b in range(bands):
        key = np.full(len(chosen), U64(b + 1))
        for r in range(rows):
            key = tw.mix(key * U64(0x9E3779B97F4A7C15) + mins[:, b * rows + r])
        out[:, b] = key
    return out


def keys_of(docs: DataFrame, reach: int, min_words: int, bands: int, rows: int, natural: bool = False) -> DataFrame:
    """(key, value): each band key of each paragraph with the paragraph's id, and each id with a hash of where it stands.

    A key with two values is shared by two paragraphs, or an id by two places. The same key twice in a batch is sent twice at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, w in tw.split(batch.column(1)):
                p = Paragraphs(w, reach, min_words, natural)
                ids = p.ids()
                doc = batch.column(0).take(pa.array(at + p.doc)).to_numpy().view(U64)
                place = tw.mix(tw.mix(doc + U64(1)) ^ p.texts()) + p.position.astype(U64)
                order = np.lexsort((place, ids))
                first = np.ones(len(ids), bool)
                first[1:] = ids[order[1:]] != ids[order[:-1]]
                last = np.append(first[1:], True)[: len(ids)]
                pid, low = ids[order[first]], place[order[first]]
                more = place[order[last]] != low
                own = _bands(p, order[first], bands, rows)
                key = np.concatenate([own.T.ravel(), pid, pid[more]])
                value = np.concatenate([np.tile(pid, bands), low, place[order[last]][more]])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(value.view(np.int64))], names=["key", "value"])

    return _batches(docs).mapInArrow(run, "key long, value long")


def candidates(docs: DataFrame, reach: int, min_words: int, bands: int, rows: int, shared, natural: bool = False) -> DataFrame:
    """(pid, bands, grams): the paragraphs of which the sieve ``shared`` lets band keys through, with those keys and the trigram set; once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in tw.split(batch.column(1)):
                p = Paragraphs(w, reach, min_words, natural)
                pid, at = np.unique(p.ids(), return_index=True)
                own = _bands(p, at, bands, rows)
                through = shared.value.has(own.ravel()).reshape(own.shape)
                use = through.any(axis=1)
                if not use.any():
                    continue
                grams, first = p.sets(at[use])
                ends = np.concatenate([[0], np.cumsum(through[use].sum(axis=1))])
                lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(x.view(np.int64))) for e, x in ((ends, own[use][through[use]]), (first, grams))]
                yield pa.RecordBatch.from_arrays([pa.array(pid[use].view(np.int64)), *lists], names=["pid", "bands", "grams"])

    return _batches(docs).mapInArrow(run, "pid long, bands array<long>, grams array<long>")


def occurrences(docs: DataFrame, reach: int, min_words: int, wanted, natural: bool = False) -> DataFrame:
    """(pid, doc_id, txt, position, pieces, words) of the paragraphs whose ids the sieve ``wanted`` lets through; txt is a hash of the document's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, w in tw.split(batch.column(1)):
                p = Paragraphs(w, reach, min_words, natural)
                ids = p.ids()
                use = np.flatnonzero(wanted.value.has(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[use].view(np.int64)), batch.column(0).take(pa.array(at + p.doc[use])), pa.array(p.texts()[use].view(np.int64)), pa.array(p.position[use]), pa.array(p.pieces[use]), pa.array((p.ends - p.starts)[use])],
                    names=["pid", "doc_id", "txt", "position", "pieces", "words"],
                )

    return _batches(docs).mapInArrow(run, "pid long, doc_id long, txt long, position long, pieces long, words long")


_PLACE = ("doc_id", "txt", "position")


def _later(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` after the first of their group, which is ``k``; only groups in several places are joined."""
    place = F.struct(*_PLACE, "pieces")
    kept = placed.groupBy("grp").agg(F.min(place).alias("k"), F.max(F.struct(*_PLACE)).alias("last")).where(F.struct(*(f"k.{c}" for c in _PLACE)) < F.col("last"))
    return placed.join(kept.select("grp", "k"), "grp").where(F.struct(*_PLACE) > F.struct(*(f"k.{c}" for c in _PLACE)))


def similar(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of which the exact Jaccard of the trigram sets reaches the threshold."""
    # Sizes go first: most pairs that can't be similar end there, before any set is moved.
    sizes = grams.select("pid", F.size("grams").alias("n"))
    pairs = pairs.join(sizes.withColumnsRenamed({"pid": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"pid": "b", "n": "n_b"}), "b")
    pairs = pairs.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")).select("a", "b")
    both = pairs.join(grams.select(F.col("pid").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("pid").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b")


#: Members of a band, or of a trigram within it, that are compared in one part with those that its first comparison left over.
SALTED = 4096
#: Bands of at most so many members are compared pair by pair; in larger ones a pair has to share a rare trigram first.
PLAIN = 16
#: Pairs of components that are still apart, beyond which rounds of one pair a component come before the last comparison.
MANY = 1 << 18


def _rare(rest: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """(band, gram, c, rank, n, small, pid, root, marks): of each member of a band the rarest of its trigrams there, of which any similar pair shares one.

    A similar pair shares ``threshold`` of the larger set at least, and 2 t / (1 + t) of the smaller one. So under one order
    of a band's trigrams the first they share is among the larger one's first n - t n + 1, and where ``small`` says so in the smaller one.
    The order is by the number of members that have the trigram, so that it is a rare one where there is any; those of one member alone count for the rank and then go.
    ``marks`` has the parity of the trigrams in each of 64 bins: two sets differ by as many trigrams as their marks by bits, or more.
    """
    own = rest.where("pid <> low").select("band", "pid", "root").join(grams, "pid")
    own = own.select("band", "pid", "root", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    own = own.withColumn("c", F.count("*").over(Window.partitionBy("band", "gram")))
    mark = F.expr("shiftleft(1L, CAST(pmod(xxhash64(gram), 64) AS INT))")
    own = own.groupBy("band", "pid").agg(F.bit_xor(mark).alias("marks"), F.first("root").alias("root"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("order"))
    first = lambda share: (F.col("n") - F.ceil(F.col("n") * share - 1e-6) + 1).cast("int")
    own = own.select("band", "pid", "root", "n", "marks", first(2 * threshold / (1 + threshold)).alias("few"), F.posexplode(F.slice("order", F.lit(1), first(threshold))).alias("rank", "at"))
    return own.where("at.c > 1").select("band", "at.gram", "at.c", "rank", "n", (F.col("rank") < F.col("few")).alias("small"), "pid", "root", "marks")


def _met(rare: DataFrame, threshold: float, hub: bool) -> DataFrame:
    """(a, b, root_x, root_y): pairs of different components that may be similar by their sizes, their marks and where their first common trigram stands.

    A pair comes once for each band and trigram that shows it. With ``hub``, of the sets of like sizes that have a trigram of a band only the pairs with the largest.
    """
    own, key = ("rank", "n", "pid", "root", "marks"), ["band", "gram"]
    if hub:
        key.append("like")
        rare = rare.withColumn("like", F.floor(F.log("n") / -F.log(F.lit(threshold))))
        large = rare.groupBy(*key).agg(F.max_by(F.struct(*own), F.struct("n", "pid")).alias("h")).select(*key, *(f"h.{c}" for c in own))
        small = rare
    else:
        key.append("part")
        parts = F.ceil(F.col("c") / SALTED).cast("int")
        large = rare.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        small = rare.where("small").withColumn("part", F.pmod(F.xxhash64("pid"), parts.cast("long")).cast("int"))
    x, y = (t.select(*key, *(F.col(c).alias(f"{c}_{end}") for c in own)) for t, end in ((large, "x"), (small, "y")))
    need = F.ceil((F.col("n_x") + F.col("n_y")) * (threshold / (1 + threshold)) - 1e-6)
    left = F.least(F.col("n_x") - F.col("rank_x"), F.col("n_y") - F.col("rank_y"))
    both = x.join(y, key).where("root_x <> root_y AND (n_y < n_x OR n_y = n_x AND pid_y < pid_x)")
    both = both.where((F.col("n_y") >= F.col("n_x") * threshold - 1e-6) & (left >= need))
    both = both.where(F.bit_count(F.col("marks_x").bitwiseXOR(F.col("marks_y"))) <= (F.col("n_x") + F.col("n_y")) * ((1 - threshold) / (1 + threshold)) + 1e-6)
    return both.select(F.least("pid_x", "pid_y").alias("a"), F.greatest("pid_x", "pid_y").alias("b"), "root_x", "root_y")


def _one_each(met: DataFrame, number: int) -> DataFrame:
    """(a, b): one pair of each component in ``met``, another one with another ``number``. Map tasks send one a component."""
    h = F.xxhash64("a", "b", F.lit(number))
    ends = met.select("a", "b", h.alias("h"), F.explode(F.array("root_x", "root_y")).alias("root"))
    return ends.groupBy("root").agg(F.min_by("a", "h").alias("a"), F.min_by("b", "h").alias("b")).select("a", "b").distinct()


def linked(members: DataFrame, grams: DataFrame, threshold: float, plain: int = PLAIN) -> DataFrame:
    """(node, root): components of the paragraphs (band, pid) under the similar pairs that share a band. ``grams`` has each pid's set."""
    lows = members.groupBy("band").agg(F.min("pid").alias("low"), F.count("*").alias("n"))
    members = storage.keep(members.join(lows, "band"), "members")
    star = storage.keep(similar(members.where("pid <> low").select(F.col("low").alias("a"), F.col("pid").alias("b")).distinct(), grams, threshold), "star")

    def asked(pairs: DataFrame, name: str) -> DataFrame:
        """The similar ones of the pairs."""
        wanted = sieve.of(pairs.select("a").union(pairs.select("b")), "a")
        out = storage.keep(similar(pairs, grams.where(sieve.through(wanted)("pid")), threshold), name)
        wanted.destroy()
        return out

    def rerooted(t: DataFrame, roots: DataFrame, *columns: tuple[str, str]) -> DataFrame:
        """``t`` with the root of each first column as the second; what isn't in ``roots`` is its own."""
        for of, to in columns:
            found = roots.select(F.col("node").alias(of), F.col("root").alias("__root"))
            t = t.join(found, of, "left").withColumn(to, F.coalesce("__root", of)).drop("__root")
        return t

    roots = storage.keep(storage.components(star), "roots")
    storage.give_back(members.sparkSession)
    # A band of two is done; in others, what isn't in the least one's component meets the rest that is in another.
    rest = storage.keep(rerooted(members.where("n > 2"), roots, ("pid", "root"), ("low", "low_root")), "rest")
    few = rest.where(F.col("n") <= plain)
    out = few.where("root <> low_root").select("band", F.col("pid").alias("a"), F.col("root").alias("a_root"))
    met = few.where("pid <> low").select("band", F.col("pid").alias("b"), F.col("root").alias("b_root"), (F.col("root") == F.col("low_root")).alias("inside"))
    pairs = out.join(met, "band").where("a_root <> b_root AND (inside OR a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # In larger bands, all that share a rare trigram there are first compared with one of them, so that copies of copies end in one component.
    rare = storage.keep(_rare(rest.where(F.col("n") > plain), grams, threshold), "rare")
    pairs = storage.keep(pairs.union(_met(rare, threshold, True).select("a", "b")).distinct(), "pairs")
    found = star.union(asked(pairs, "more"))
    roots = storage.keep(storage.components(found), "roots")
    # Variants of one text are alike by the square of their number, but a link a component and round joins them.
    number, apart = 0, _met(rerooted(rare, roots, ("root", "root")), threshold, False)
    while apart.count() > MANY:
        number += 1
        some = storage.keep(_one_each(apart, number), "some")
        more = asked(some, "more")
        found, n = found.union(more), more.count()
        if n:
            roots = storage.keep(storage.components(found), "roots")
            apart = _met(rerooted(rare, roots, ("root", "root")), threshold, False)
        if 8 * n < some.count():
            break
    # Only those that are still apart are compared pair by pair.
    pairs = storage.keep(apart.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = asked(pairs, "more")
    return storage.keep(storage.components(found.union(more)), "roots") if more.take(1) else roots


def _marks(docs: DataFrame, threshold: float, recall: float, most_bands: int, reach: int, min_words: int, min_run: int, natural: bool) -> DataFrame:
    """(doc_id, txt, position, kept_doc, kept_position) of the pieces to remove."""
    storage.lean(docs.sparkSession)
    bands, rows = tune_bands(threshold, recall, most_bands)
    shared = keys_of(docs, reach, min_words, bands, rows, natural).groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high")
    shared = storage.keep(shared.select("key"), "shared")
    storage.give_back(docs.sparkSession)
    sieved = sieve.of(shared, "key")
    found = storage.keep(candidates(docs, reach, min_words, bands, rows, sieved, natural).dropDuplicates(["pid"]), "candidates")
    sieved.destroy()
    storage.give_back(docs.sparkSession)
    # The sieve lets some keys through by mistake, which have one paragraph.
    members = found.select(F.explode("bands").alias("band"), "pid").join(shared.withColumnRenamed("key", "band"), "band", "left_semi")
    roots = linked(members, found.select("pid", "grams"), threshold)
    storage.give_back(docs.sparkSession)
    wanted = sieve.of(shared.union(roots.select("node")).union(roots.select("root")), "key")
    own = occurrences(docs, reach, min_words, wanted, natural).join(roots.withColumnRenamed("node", "pid"), "pid", "left")
    placed = storage.keep(own.select(F.coalesce("root", "pid").alias("grp"), *_PLACE, "pieces", "words"), "placed")
    wanted.destroy()
    storage.drop(found, shared)
    storage.give_back(docs.sparkSession)

    def result(t: DataFrame, step) -> DataFrame:
        t = t.withColumn("at", F.col("position") + step).withColumn("share", F.col("words") / F.greatest("pieces", F.lit(1)))
        place = F.struct(F.col("k.doc_id").alias("kept_doc"), (F.col("k.position") + F.least(step, F.greatest(F.lit(1), "k.pieces") - 1)).alias("kept_position"))
        return t.groupBy("doc_id", "txt", F.col("at").alias("position")).agg(F.max("share").alias("words"), F.min(place).alias("kept"))

    if natural:
        whole = _later(placed.where("pieces > 0")).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        whole = storage.keep(result(whole, F.col("step")), "whole")
        # What stands in a paragraph that goes keeps no other piece from staying.
        left = placed.where("pieces < 2").join(whole.select(*_PLACE), [*_PLACE], "left_anti")
        marks = whole.union(result(_later(storage.keep(left.select("grp", *_PLACE, "pieces", "words"), "left")), F.lit(0).cast("long")))
    else:
        marks = result(_later(placed), F.lit(0).cast("long"))
    # Runs of neighbouring repeats, document by document.
    by_doc = Window.partitionBy("doc_id", "txt")
    runs = marks.withColumn("run", F.col("position") - F.row_number().over(by_doc.orderBy("position")))
    runs = runs.withColumn("in_run", F.sum("words").over(Window.partitionBy("doc_id", "txt", "run"))).where(F.col("in_run") >= min_run - 1e-6)
    return runs.select(*_PLACE, "kept.kept_doc", "kept.kept_position")


def repeats(docs: DataFrame, threshold: float = 0.8, recall: float = 0.95, most_bands: int = 5, reach: int = 8, min_words: int = 8, min_run: int = 18, natural: bool = False) -> DataFrame:
    """(doc_id, position, duplicate_of, duplicate_position): each paragraph to remove, and the one of its component that stays.

    With ``natural``, natural paragraphs go whole where an earlier one is like them, and then pieces of what is left.
    """
    marks = _marks(docs, threshold, recall, most_bands, reach, min_words, min_run, natural)
    return marks.select("doc_id", "position", F.col("kept_doc").alias("duplicate_of"), F.col("kept_position").alias("duplicate_position")).distinct()


def without_repeats(docs: DataFrame, threshold: float = 0.8, recall: float = 0.95, most_bands: int = 5, reach: int = 8, min_words: int = 8, min_run: int = 18, natural: bool = False, length: str | None = None) -> DataFrame:
    """``docs`` with the repeated paragraphs cut out of their texts. A text of which nothing is left is empty; its row stays.

    A cut is of one doc_id and one text: another row of the doc_id that has another text loses only its own repeats.
    Where there is a column ``length``, it follows the texts that were cut, in characters.
    """
    key, txt, own_txt, mark = storage.fresh(docs, "__id", "__txt", "__own", "__gone")
    marks = _marks(docs, threshold, recall, most_bands, reach, min_words, min_run, natural)
    gone = storage.keep(marks.groupBy(F.col("doc_id").alias(key), F.col("txt").alias(txt)).agg(F.collect_set("position").alias(mark)), "gone")

    @F.arrow_udf(T.LongType())
    def hashed(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), U64)
        for at, w in tw.split(texts):
            out[at : at + len(w.first) - 1] = spans(w, w.first[:-1], w.first[1:])
        return pa.array(out.view(np.int64))

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, positions: pa.Array) -> pa.Array:
        return pa.array([t if not g or t is None else _cut(t, reach, set(g)) for t, g in zip(texts.to_pylist(), positions.to_pylist())], pa.string())

    # Only texts that may lose something are moved to where it says what.
    may_lose = sieve.through(sieve.of(gone, key))
    touched = docs.where(may_lose("doc_id")).withColumn(own_txt, hashed("text"))
    joined = touched.join(gone, (touched["doc_id"].cast("long") == gone[key]) & (touched[own_txt] == gone[txt]), "left")
    # What isn't cut has a null here; the cut text is made once, and measured.
    less = storage.fresh(docs, "__less")[0]
    joined = joined.withColumn(less, F.when(F.col(mark).isNotNull(), cut("text", mark)))
    kinds = dict(docs.dtypes)

    def column(c: str):
        if c.lower() == "text":
            return F.coalesce(less, "text").alias(c)
        if length and c.lower() == length.lower():
            return F.coalesce(F.length(less).cast(kinds[c]), F.col(c)).alias(c)
        return F.col("`" + c.replace("`", "``") + "`")

    return docs.where(~may_lose("doc_id")).union(joined.select([column(c) for c in docs.columns]))


def _cut(text: str, reach: int, gone: set[int]) -> str:
    """``text`` without its paragraphs at the positions ``gone``, each from its first word to the next one's."""
    column = pa.array([text])
    p = Paragraphs(tw.words(*tw.buffers(column)), reach, 0)
    # Lower-casing can change a text's bytes but not which of them are words, so the words' numbers agree.
    start = tw.words(*tw.buffers(column, lower=False)).start
    raw = text.encode()
    edges = np.append(start[p.starts], len(raw)).tolist()
    parts = [raw[: edges[0]], *(raw[edges[k] : edges[k + 1]] for k in range(len(edges) - 1) if k not in gone)]
    return b"".join(parts).decode()
