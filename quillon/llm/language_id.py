"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a linear classifier over hashed byte trigrams
of the lower-cased text says whether the text's language has it. With few languages the code is
exhaustive (all splits of the languages in two), with more a random one of ``10 log2`` bits whose
least distance between codewords is the best of some tries. A text is decoded to the codeword of
least loss: the logistic loss of each bit's margin, weighted by how reliable the bit was on held-out
text. If the second best loss is within ``margin`` of the best (as shares of the total weight),
the text is flagged as ambiguous.

Training uses a bounded sample: at most ``train_docs`` documents of each language, those of least hash
of their doc_id, one in five of them held out for the weights. Only their trigram counts, 2**BUCKET_BITS a text at most, come to the driver. All texts are then scored whole, in one
pass and without a shuffle; the classifiers (2**BUCKET_BITS rows of a few floats) are broadcast.

Edge cases. Null and blank texts, and any text if there are no labelled languages, get a null prediction
and count as ambiguous. With one language all other texts are of that one. Rows with a null language are
scored, not trained on. Repeated rows are each scored; of rows of one doc_id and language with different texts the least text
is trained on. Ties of hashes go to the smaller doc_id, equal losses to the language that comes first. With fewer than ten training texts none is
held out and all bits weigh the same. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import storage
from quillon.llm import textwords as tw

BUCKET_BITS = 15


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        bits = [[1] + [1 if (s >> j) & 1 else -1 for j in range(k - 1)] for s in range(2 ** (k - 1) - 1)]
        return np.array(bits, float).T
    length = int(np.ceil(10 * np.log2(k)))
    rng, best, least = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, length))
        code = code[:, (code.min(axis=0) < 0) & (code.max(axis=0) > 0)]
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if apart > least:
            best, least = code, apart
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigram at each byte of a text but its last two (a shorter text has one, of what it has), and the offsets of the texts."""
    x = np.zeros(len(data) + 2, np.uint32)
    x[: len(data)] = data
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    size = np.diff(offsets)
    use = np.ones(len(data), bool)
    long = offsets[1:][size >= 3]
    use[long - 1] = use[long - 2] = False
    for s in np.flatnonzero((size > 0) & (size < 3)):
        a, b = offsets[s], offsets[s + 1]
        h[a] = int.from_bytes(data[a:b].tobytes(), "big") << 8 * int(3 - (b - a))
        use[a + 1 : b] = False
    bucket = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    first = np.concatenate([[0], np.cumsum(use)])[offsets]
    return bucket[use], first


class Coder:
    """Codewords, the bits' classifiers and their weights."""

    def __init__(self, langs: list[str], code: np.ndarray, table: np.ndarray, bias: np.ndarray, weight: np.ndarray) -> None:
        self.langs, self.code, self.table, self.bias, self.weight = langs, code, table, bias, weight

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The classifiers' outputs for each text: mean weight of its trigrams, and bias."""
        out = np.zeros((len(offsets) - 1, self.table.shape[1]))
        for i, j in tw.groups(offsets, 1 << 18):
            bucket, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = np.diff(first)
            some = size > 0
            if len(bucket):
                sums = np.add.reduceat(self.table[bucket], first[:-1][some], axis=0, dtype=np.float32)
                out[i:j][some] = sums / size[some][:, None]
        return out + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number, and by how much its loss is less than the second's."""
        losses = np.stack([(self.weight * np.logaddexp(0, -word * margins)).sum(axis=1) for word in self.code], axis=1)
        order = np.argsort(losses, axis=1, kind="stable")
        rows = np.arange(len(losses))
        best = order[:, 0]
        gap = losses[rows, order[:, 1]] - losses[rows, best] if losses.shape[1] > 1 else np.full(len(losses), np.inf)
        return best, gap / self.weight.sum()


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the texts' cells: each bucket's share of the text's trigrams, in the order of rows and buckets."""
    data, offsets = tw.buffers(texts)
    bucket, first = features(data, offsets)
    size = np.diff(first)
    cell, count = np.unique(np.repeat(np.arange(len(size)), size) << BUCKET_BITS | bucket, return_counts=True)
    row = cell >> BUCKET_BITS
    return row, cell & ((1 << BUCKET_BITS) - 1), count / np.maximum(size, 1)[row]


def fit(texts: list[str], langs: list[str], epochs: int = 30, rate: float = 2.0) -> Coder | None:
    """As :func:`fit_cells`, from the texts themselves."""
    return fit_cells(*counts(pa.array(texts, pa.string())), langs, epochs, rate)


def fit_cells(row: np.ndarray, column: np.ndarray, value: np.ndarray, langs: list[str], epochs: int = 30, rate: float = 2.0) -> Coder | None:
    """Trains the bits' classifiers by gradient steps on the counts; one text in five sets the weights."""
    names = sorted(set(langs))
    if not names:
        return None
    code = codewords(len(names))
    n, width = len(langs), 1 << BUCKET_BITS
    target = code[[names.index(x) for x in langs]]
    held = np.arange(n) % 5 == 4
    if n < 10:
        held[:] = False
    train = ~held
    use = train[row]
    row_t, column_t, value_t = row[use], column[use], value[use]
    table, bias = np.zeros((width, code.shape[1])), np.zeros(code.shape[1])
    square = np.full(width, 1e-8)
    np.add.at(square, column_t, value_t**2)
    scale = rate / np.sqrt(square)

    def apply(r: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty((n, code.shape[1]))
        for b in range(code.shape[1]):
            out[:, b] = np.bincount(r, v * table[c, b], minlength=n)
        return out + bias

    for _ in range(epochs):
        f = apply(row_t, column_t, value_t)
        g = -target / (1 + np.exp(np.clip(target * f, -30, 30))) * train[:, None]
        for b in range(code.shape[1]):
            step = np.bincount(column_t, value_t * g[row_t, b], minlength=width)
            table[:, b] -= scale * step / np.sqrt(max(1, train.sum()))
        bias -= 0.1 * g.sum(axis=0) / max(1, train.sum())
    if held.any():
        f = apply(row, column, value)
        wrong = (np.sign(f[held]) != target[held]).mean(axis=0)
    else:
        wrong = np.zeros(code.shape[1])
    return Coder(names, code, table.astype(np.float32), bias, np.maximum(1 - 2 * wrong, 0.01))


def train(docs: DataFrame, train_docs: int = 400) -> Coder | None:
    """Fits the classifiers on the bounded sample of ``docs``."""
    storage.lean(docs.sparkSession)
    texts = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND trim(text) <> ''").select("doc_id", "lang", "text")
    ids = storage.keep(texts.select("doc_id", "lang").distinct(), "ids")
    chosen = storage.keep(storage.least_by_hash(ids, "lang", "doc_id", train_docs), "chosen")
    sample = texts.join(chosen.select("doc_id", "lang"), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, value = counts(batch.column(2))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value))], names=["doc_id", "lang", "bucket", "value"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = storage.keep(sample.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, bucket array<int>, value array<double>"), "counts")
    table = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").toArrow()
    storage.drop(ids, chosen, rows)
    if not table.num_rows:
        return None
    bucket, value = table.column("bucket").combine_chunks(), table.column("value").combine_chunks()
    row = np.repeat(np.arange(table.num_rows), np.diff(bucket.offsets.to_numpy()))
    return fit_cells(row, bucket.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), table.column("lang").to_pylist())


def identify(docs: DataFrame, train_docs: int = 400, margin: float = 0.02) -> DataFrame:
    """(doc_id, lang, predicted, gap, ambiguous) of each row of ``docs``."""
    coder = docs.sparkSession.sparkContext.broadcast(train(docs, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = coder.value
            data, offsets = tw.buffers(batch.column("text"))
            none = np.array([c is None or not (x or "").strip() for x in batch.column("text").to_pylist()], bool)
            if c is None or not batch.num_rows:
                names, gap = [None] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                best, gap = c.decode(c.margins(data, offsets))
                names = [None if x else c.langs[b] for x, b in zip(none, best)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(names, pa.string()), pa.array(np.round(gap, 6), mask=none), pa.array(none | (gap < margin))], names=["doc_id", "lang", "predicted", "gap", "ambiguous"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, predicted string, gap double, ambiguous boolean")
