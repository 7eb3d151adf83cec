"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over UTF-8 bytes, of order 5 (1 to 5), one set of counts for each language.
Trusted text is that of labelled documents of quality 1 that aren't toxic. All of it is used: one document in
``hold_out``, by hash of its doc_id, is held out (of fewer documents than that, one), and all others are counted. The held-out text is scored to set
the language's threshold: the ``quantile`` of the scores, times ``slack``. (A quantile of all documents
would reject the same share of any corpus, however clean.) A document is rejected if its perplexity
is above its language's threshold.

Counting and smoothing are joins and aggregations sharded by n-gram: continuation counts come
from the distinct n-grams one order up, discounts D1, D2, D3+ from the counts of counts, and
each n-gram joins its context's totals and its suffix's lower-order probability. The resulting
table grows with the distinct n-grams of the trusted text. It is broadcast in shards of about ``shard_entries`` entries at most, which are compiled
one after another; a worker holds one at a time. Shards are cut by the byte before the predicted one, so every n-gram, context and suffix that a
byte needs is in the same shard, and each shard's pass adds its bytes' part to the documents'
sums. All texts are scored whole, once and without a shuffle of texts: thresholds and decisions come from the kept sums.

Perplexity is exp of the mean negative log probability of a byte. So that few bytes don't decide,
``prior`` bytes at the language's held-out mean are added to each text: a short text is judged
only if it is very odd.

Edge cases. Null and empty texts, null languages and languages of fewer than two trusted documents have a null
perplexity and aren't rejected. Repeated rows are each scored. Labels of absent documents are
ignored, as are null labels; a document labelled more than once is trusted if any row says so.
Without labels nothing is rejected. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import sieve, storage
from quillon.llm import textwords as tw

ORDER = 5
U64 = np.uint64
_BEFORE = 2  # the byte put before a text, ORDER - 1 times


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each text behind ORDER - 1 marks, and for each byte whether it is the text's own."""
    n = len(offsets) - 1
    shift = (ORDER - 1) * np.arange(1, n + 1)
    out = np.full(len(data) + (ORDER - 1) * n, _BEFORE, np.uint8)
    own = np.zeros(len(out), bool)
    at = np.arange(len(data)) + np.repeat(shift, np.diff(offsets))
    out[at] = data
    own[at] = True
    return out, own


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each byte, as an integer; the first n - 1 are cut short."""
    out = data.astype(U64)
    for k in range(1, n):
        out[k:] |= data[:-k].astype(U64) << U64(8 * k)
    return out


#: Distinct n-grams that a task holds before it sends them on.
_MOST_HELD = 1 << 20


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of several tables of n-grams as one."""
    gram, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(gram, kind="stable")
    gram, c = gram[order], c[order]
    heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)])
    return gram[heads], np.add.reduceat(c, heads) if len(heads) else c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, c) of full-order n-grams; a task sends each a few times at most."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def sent(lang: str) -> pa.RecordBatch:
        gram, c = _summed(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(gram), np.int64))), pa.array(gram.view(np.int64)), pa.array(c)], names=["lang", "gram", "c"])

    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        data, offsets = tw.buffers(batch.column("text"), lower=False)
        for lang in sorted(set(langs)):
            pieces = [data[offsets[r] : offsets[r + 1]] for r in np.flatnonzero(langs == lang)]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            own_data = np.concatenate(pieces)
            for i, j in tw.groups(ends):
                text, own = padded(own_data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                parts = held.setdefault(lang, [])
                parts.append(np.unique(grams(text, ORDER)[own], return_counts=True))
                # The first is the sum so far; the others are added when they are as many.
                if sum(len(g) for g, _ in parts[1:]) > max(len(parts[0][0]), 1 << 17):
                    parts[:] = [_summed(parts)]
        while held and sum(len(g) for parts in held.values() for g, _ in parts) > 2 * _MOST_HELD:
            yield sent(max(held, key=lambda lang: sum(len(g) for g, _ in held[lang])))
    for lang in list(held):
        yield sent(lang)


def _orders(counts: DataFrame) -> DataFrame:
    """(lang, n, gram, c) for every order: counts at the highest, below it the numbers of distinct one-longer n-grams that end so."""
    full = storage.keep(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")
    out = full.select("lang", F.lit(ORDER).alias("n"), "gram", "c")
    for n in range(1, ORDER):
        longer = full.select("lang", F.col("gram").bitwiseAND((1 << (8 * (n + 1))) - 1).alias("gram")).distinct()
        out = out.union(longer.groupBy("lang", F.lit(n).alias("n"), F.col("gram").bitwiseAND((1 << (8 * n)) - 1).alias("gram")).agg(F.count("*").alias("c")))
    return storage.keep(out, "orders")


def _discounts(orders: DataFrame) -> DataFrame:
    """(lang, n, d1, d2, d3) by Chen and Goodman's estimates, held within the count; where counts of counts are 0, 0.5."""
    of = {k: F.sum(F.when(F.col("c") == k, 1).otherwise(0)) for k in (1, 2, 3, 4)}
    t = orders.groupBy("lang", "n").agg(*(x.cast("double").alias(f"n{k}") for k, x in of.items()))
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))

    def d(k: int) -> Column:
        low, high = F.col(f"n{k}"), F.col(f"n{k + 1}")
        return F.when((low > 0) & (high > 0), F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * high / low))).otherwise(F.lit(0.5))

    return t.select("lang", "n", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def model_table(counts: DataFrame) -> DataFrame:
    """(lang, n, gram, logp, back): log probability of each n-gram's last byte, and as a context the log weight of the lower order.

    ``counts`` has (lang, gram, c) of the full-order n-grams.
    """
    orders = _orders(counts)
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    t = orders.join(_discounts(orders), ["lang", "n"]).select("lang", "n", "gram", "c", F.least(F.col("c").cast("double"), cut).alias("cut"), F.shiftright("gram", 8).alias("context"))
    sums = storage.keep(t.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("weight")), "contexts")
    t = storage.keep(t.join(sums, ["lang", "n", "context"]).select("lang", "n", "gram", ((F.col("c") - F.col("cut")) / F.col("total")).alias("alpha"), "weight"), "alphas")
    lower = t.where("n = 1").select("lang", "n", "gram", (F.col("alpha") + F.col("weight") / 256).alias("p"))
    out = lower
    for n in range(2, ORDER + 1):
        below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        own = t.where(f"n = {n}").withColumn("suffix", F.col("gram").bitwiseAND((1 << (8 * (n - 1))) - 1))
        lower = storage.keep(own.join(below, ["lang", "suffix"]).select("lang", "n", "gram", (F.col("alpha") + F.col("weight") * F.col("below")).alias("p")), f"order{n}")
        out = out.union(lower)
    back = sums.select("lang", (F.col("n") - 1).alias("n"), F.col("context").alias("gram"), F.log("weight").alias("back"))
    return out.select("lang", "n", "gram", F.log("p").alias("logp")).join(back, ["lang", "n", "gram"], "full")


class Model:
    """A shard of the table as a hash table in arrays: linear probing, five eighths full."""

    def __init__(self, langs: list[str], lang: np.ndarray, n: np.ndarray, gram: np.ndarray, logp: np.ndarray, back: np.ndarray) -> None:
        self.langs = {name: i for i, name in enumerate(langs)}
        key = self.key(lang, n, gram)
        self.size = 16 + 8 * len(key) // 5
        self.keys = np.full(self.size, ~U64(0))
        self.logp, self.back = np.zeros(self.size, np.float32), np.zeros(self.size, np.float32)
        left, at = np.arange(len(key)), self.slot(key)
        while len(left):
            free = self.keys[at] == ~U64(0)
            cells, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[cells] = key[left[won]]
            self.logp[cells], self.back[cells] = logp[left[won]], back[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], self.after(at[rest])

    @staticmethod
    def key(lang: np.ndarray, n: np.ndarray | int, gram: np.ndarray) -> np.ndarray:
        return (np.asarray(lang).astype(U64) << U64(43)) | (np.asarray(n).astype(U64) << U64(40)) | gram.astype(U64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((((key * U64(0x9E3779B97F4A7C15)) >> U64(32)) * U64(self.size)) >> U64(32)).astype(np.int64)

    def after(self, at: np.ndarray) -> np.ndarray:
        """The cell after each."""
        at = at + 1
        at[at == self.size] = 0
        return at

    def find(self, key: np.ndarray) -> np.ndarray:
        """The cell of each key, or -1."""
        at = self.slot(key)
        seen = self.keys[at]
        left = np.flatnonzero(seen != key)
        out = at
        at = at[left]
        while len(left):
            free = self.keys[at] == ~U64(0)
            out[left[free]] = -1
            left, at = left[~free], self.after(at[~free])
            hit = self.keys[at] == key[left]
            out[left[hit]] = at[hit]
            left, at = left[~hit], at[~hit]
        return out

    def score(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each full-order gram."""
        out = np.zeros(len(gram), np.float64)
        cell = self.find(self.key(lang, ORDER, gram))
        hit = cell >= 0
        out[hit] = self.logp[cell[hit]]
        left = np.flatnonzero(~hit)
        for n in range(ORDER - 1, -1, -1):
            if not len(left):
                break
            g, own = gram[left], lang[left]
            context = self.find(self.key(own, n, (g >> U64(8)) & U64((1 << (8 * n)) - 1)))
            out[left] += np.where(context >= 0, self.back[context], 0)
            if not n:
                out[left] += np.log(1 / 256)
                break
            cell = self.find(self.key(own, n, g & U64((1 << (8 * n)) - 1)))
            hit = cell >= 0
            out[left[hit]] += self.logp[cell[hit]]
            left = left[~hit]
        return out


def compiled(table: DataFrame, shard_entries: int) -> Iterator[tuple[Model, int, int]]:
    """(model, shard, shards): the table in as many shards as keep each within ``shard_entries`` entries, about; one at a time."""
    langs = sorted(r.lang for r in table.select("lang").distinct().collect())
    shards = -(-table.count() // shard_entries)
    for s in range(shards):
        # The byte before the predicted one: the last of a context, the last but one of an n-gram.
        mine = lambda byte: F.pmod(byte.bitwiseAND(255), F.lit(shards)) == s
        rows = table.where((F.col("n") < 2) | mine(F.shiftrightunsigned("gram", 8)) | mine(F.col("gram"))).toArrow()
        code = np.searchsorted(np.array(langs, object), rows.column("lang").to_numpy().astype(object)) if rows.num_rows else np.zeros(0, np.int64)
        logp, back = (np.nan_to_num(rows.column(c).to_numpy()) for c in ("logp", "back"))
        yield Model(langs, code, rows.column("n").to_numpy(), rows.column("gram").to_numpy().view(U64), logp, back), s, shards


def score_batch(model: Model, langs: np.ndarray, data: np.ndarray, offsets: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Each text's sum of log probabilities over the bytes that this shard predicts."""
    sums = np.zeros(len(offsets) - 1)
    code = np.array([model.langs.get(x, -1) for x in langs], np.int64)
    for i, j in tw.groups(offsets):
        text, own = padded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        gram = grams(text, ORDER)[own]
        doc = np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]))
        use = code[doc] >= 0
        if shards > 1:
            use &= ((gram >> U64(8)) & U64(255)) % U64(shards) == shard
        if not use.all():
            gram, doc = gram[use], doc[use]
        sums[i:j] += np.bincount(doc - i, model.score(code[doc], gram), minlength=j - i)
    return sums


class Quality:
    """The trained model, its thresholds by language, and how to apply them to documents."""

    def __init__(self, shards, means: dict[str, float], limits: dict[str, float], prior: int, spark: SparkSession) -> None:
        self.shards, self.langs = [], []
        for model, s, of in shards:
            self.langs = sorted(model.langs)
            self.shards.append((spark.sparkContext.broadcast(model), s, of))
        self.means, self.limits, self.prior = means, limits, prior
        #: The documents that were scored in training, and their sums.
        self.docs = self.own = None

    def _adder(self) -> Callable:
        """A function of languages and texts for workers: sums of log probabilities, bytes, and which rows have no model."""
        models, cuts, known = [m for m, *_ in self.shards], [c for _, *c in self.shards], set(self.langs)

        def add(langs: list, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            data, offsets = tw.buffers(texts, lower=False)
            total, size = np.zeros(len(langs)), np.diff(offsets)
            for model, (s, of) in zip(storage.each(models), cuts):
                total += score_batch(model, langs, data, offsets, s, of)
            return total, size, (size == 0) | np.array([x not in known for x in langs], bool)

        return add

    def sums(self, docs: DataFrame) -> DataFrame:
        """(doc_id, lang, __key, __bits, __size): each row's sum of its bytes' log probabilities, null without a model, and their number.

        The key is a hash of language and text.
        """
        add = self._adder()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total, size, none = add(batch.column(1).to_pylist(), batch.column(3))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total, mask=none), pa.array(size)], names=["doc_id", "lang", "__key", "__bits", "__size"])

        kind = dict(docs.dtypes)["doc_id"]
        return docs.select("doc_id", "lang", _key(), "text").mapInArrow(run, f"doc_id {kind}, lang string, __key long, __bits double, __size long")

    def scored(self, docs: DataFrame) -> DataFrame:
        """(doc_id, lang, perplexity, limit, rejected) of each row."""
        return self.judged(self.own if docs is self.docs else self.sums(docs)).drop("__key")

    def judged(self, sums: DataFrame) -> DataFrame:
        """As :meth:`scored`, with the key, of rows that :meth:`sums` gave."""
        pairs = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("lang")] if values else F.lit(None).cast("double")
        ppl = F.exp((-F.col("__bits") + self.prior * pairs(self.means)) / (F.col("__size") + self.prior))
        limit = pairs(self.limits)
        return sums.select("doc_id", "lang", "__key", F.round(ppl, 6).alias("perplexity"), F.round(limit, 6).alias("limit"), F.coalesce(ppl > limit, F.lit(False)).alias("rejected"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that aren't rejected. Those that surely aren't stay where they are; only what may be rejected is joined."""
        doc, key = storage.fresh(docs, "__doc", "__key")
        sums = self.own if docs is self.docs else self.sums(docs)
        gone = storage.keep(self.judged(sums).where("rejected").select(F.col("doc_id").alias(doc), F.col("__key").alias(key)).distinct(), "rejected")
        may = sieve.through(sieve.of(gone, key))(_key())
        return docs.where(~may).union(docs.where(may).join(gone, docs["doc_id"].eqNullSafe(gone[doc]) & (_key() == gone[key]), "left_anti"))


def _key() -> Column:
    return F.xxhash64("lang", "text").alias("__key")


def train(docs: DataFrame, labels: DataFrame, hold_out: int = 5, quantile: float = 0.99, slack: float = 1.15, prior: int = 200, shard_entries: int = 4_000_000) -> Quality:
    """Trains on all trusted text of ``docs`` but what is held out, which sets each language's threshold."""
    spark = docs.sparkSession
    storage.lean(spark)
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    texts = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text <> ''").select("doc_id", "lang", "text")
    place = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    ids = storage.keep(texts.select("doc_id", "lang").join(good, "doc_id", "left_semi").distinct().withColumn("at", place), "trusted-ids")
    ends = ids.groupBy("lang").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    # The first by hash is held out and the last counted, so that no language of two documents or more lacks either.
    held = (F.col("n") > 1) & ((F.col("at") == F.col("low")) | (F.col("n") >= hold_out) & (F.pmod("at.h", F.lit(hold_out)) == 0) & (F.col("at") < F.col("high")))
    split = storage.keep(ids.join(ends, "lang").select("doc_id", "lang", held.alias("held")), "split")
    counted, rest = (split.where(x).select("doc_id", "lang") for x in ("NOT held", "held"))
    # Only texts that a sieve lets through are moved to where their ids are.
    key = F.xxhash64("doc_id", "lang")
    may = sieve.of(counted.select(key.alias("key")), "key")
    own = texts.where(sieve.through(may)(key)).join(counted.hint("shuffle_hash"), ["doc_id", "lang"], "left_semi")
    table = storage.keep(model_table(own.select("lang", "text").mapInArrow(_count, "lang string, gram long, c long")), "model")
    may.destroy()
    storage.give_back(spark)
    out = Quality(compiled(table, shard_entries), {}, {}, prior, spark)
    out.docs, out.own = docs, storage.keep(out.sums(docs), "scores")
    for model, *_ in out.shards:
        model.unpersist()
    scores = out.own.where("__size > 0 AND __bits IS NOT NULL").join(rest, ["doc_id", "lang"], "left_semi")
    means = scores.groupBy("lang").agg((-F.sum("__bits") / F.sum("__size")).alias("mean"))
    ppl = F.exp((-F.col("__bits") + prior * F.col("mean")) / (F.col("__size") + prior))
    limits = scores.join(means, "lang").groupBy("lang").agg(F.first("mean").alias("m"), F.percentile_approx(ppl, quantile, 10_000).alias("q")).collect()
    out.means, out.limits = {r.lang: float(r.m) for r in limits}, {r.lang: float(r.q) * slack for r in limits}
    storage.drop(ids, split, table)
    return out
