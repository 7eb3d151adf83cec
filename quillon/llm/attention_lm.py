"""Scoring of texts by a causal self-attention model over subword ids, in numpy.

Subwords are those of a public byte-level BPE whose rank file is a parameter; nothing of it is kept
here. Words repeat, so each distinct piece of text between white space is encoded once a batch, all in one go; the
pattern never joins over such borders, so the ids are those of the whole text.

Texts are encoded once: their ids are a table in the shared folder that counting, training and scoring read.

The model: embeddings of ids and places, one head of causal self-attention with a residual, and
a factored softmax, p(id) = p(class | context) p(id | class). Classes are bins of ids of falling frequency
and about equal mass; they and p(id | class) come from the counts of all subwords of all documents, by one
aggregation; context moves the class alone. Attention is trained on all documents, each once: rounds take growing shares of
the documents by hash of doc_id (``SHARES``), at falling rates. In a round each partition takes Adam steps
from common parameters, batch by batch, and the results are averaged, weighted by windows. Averages are
sums by parameter row in a shuffle; only the averaged model, of a size set by the vocabulary, comes to
the driver and is broadcast.

Scoring: a text's ids, behind a start mark, are cut into windows of WINDOW that overlap by OVERLAP.
The first window scores all its places, each later one those after the overlap, so every subword is scored
just once, with OVERLAP subwords of context or more (fewer only at the start). Windows of many texts are one batch of masked matrix products.

Edge cases. Null and empty texts have 0 tokens and a null perplexity. Very long texts are as many windows as
they need. Repeated rows are each scored. Ids never seen in the counts share what one count is worth.
Rows with a null doc_id are trained on and scored like others. Tables without any subword leave the model as it began; they have nothing to score. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import storage
from quillon.llm import textwords as tw

WIDTH, CLASSES, WINDOW, OVERLAP = 16, 48, 32, 8
#: The share of the documents that each round of training takes, and its rate.
SHARES = ((1 / 16, 0.01), (3 / 16, 0.004), (3 / 4, 0.002))
#: Columns of a parameter row that travel together.
COLUMNS = 16


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public byte-level BPE with 50,256 ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def lengths(path: str, pattern: str) -> np.ndarray:
    """Bytes of each id."""
    enc = encoder(path, pattern)
    out = np.zeros(enc.n_vocab, np.int64)
    for piece in enc.token_byte_values():
        out[enc.encode_single_token(piece)] = len(piece)
    return out


def space_at(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space: 9 to 13, and 32."""
    out = (data - np.uint8(9)) < 5
    out |= data == 32
    return out


class Pieces:
    """The pieces of some texts, each white space run with what follows it: which distinct piece each is, and their ids."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: tuple[str, str]) -> None:
        n = len(data)
        if not n:
            self.first, self.which = np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
            self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
            return
        space = space_at(data)
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(opens)
        runs = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, n)), pa.py_buffer(data)]).dictionary_encode()
        self.first = np.searchsorted(start, offsets)
        pieces = runs.dictionary
        # Pieces that open with white space and end with something else are encoded in one go, as one text; the few others each by itself.
        at, raw = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1], np.frombuffer(pieces.buffers()[2], np.uint8)
        last = raw[at[1:] - 1]
        joins = space_at(raw[at[:-1]]) & (last > 32)
        # White space beyond ASCII ends with these.
        joins &= (last < 0x80) | ~np.isin(raw[np.maximum(at[1:] - 3, 0)], (0xE1, 0xE2, 0xE3)) & (raw[np.maximum(at[1:] - 2, 0)] != 0xC2)
        alone = np.flatnonzero(~joins)
        order = np.concatenate([np.flatnonzero(joins), alone])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.which = place.take(runs.indices.to_numpy())
        enc = encoder(*vocabulary)
        ids, ends = self._joined(pieces.filter(pa.array(joins)), vocabulary)
        lists = [enc.encode_ordinary(x.decode()) for x in pieces.take(pa.array(alone)).to_pylist()]
        more = np.cumsum([0, *map(len, lists)], dtype=np.int64)
        self.ends = np.concatenate([ends, ends[-1] + more[1:]])
        self.ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(lists), np.int32, more[-1])])

    @staticmethod
    def _joined(pieces: pa.Array, vocabulary: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and where each piece's lie; should one id belong to two pieces, all are encoded by themselves."""
        enc = encoder(*vocabulary)
        data, at = tw.buffers(pieces, lower=False, kind=pa.large_binary())
        found = enc.encode_ordinary(data.tobytes().decode())
        ids = np.fromiter(found, np.int32, len(found))
        till = np.append(0, np.cumsum(lengths(*vocabulary).take(ids)))
        ends = np.searchsorted(till, at)
        if (till[ends] == at).all():
            return ids, ends
        lists = [enc.encode_ordinary(x.decode()) for x in pieces.to_pylist()]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
        return np.fromiter(itertools.chain.from_iterable(lists), np.int32, ends[-1]), ends

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how often) over all texts."""
        times = np.repeat(np.bincount(self.which, minlength=len(self.ends) - 1), np.diff(self.ends))
        sums = np.bincount(self.ids, times) if len(self.ids) else np.zeros(0)
        ids = np.flatnonzero(sums)
        return ids, sums[ids].astype(np.int64)

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and the texts' offsets."""
        width = self.ids.itemsize
        each = pa.Array.from_buffers(pa.large_binary(), len(self.ends) - 1, [None, pa.py_buffer(self.ends * width), pa.py_buffer(self.ids)])
        ids, till = tw.buffers(each.take(pa.array(self.which)), lower=False, kind=pa.large_binary())
        return ids.view(self.ids.dtype), till[self.first] // width


class Classes:
    """Class of each id and log p(id | class), from counts; ``vocab`` ids and the start mark after them."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vocab: int) -> None:
        c = np.zeros(vocab)
        c[ids] = counts
        unseen = c == 0
        c[unseen] = 1 / max(1, unseen.sum())
        order = np.argsort(-c, kind="stable")
        mass = np.cumsum(c[order]) - c[order] / 2
        self.of = np.empty(vocab, np.int64)
        self.of[order] = np.minimum((mass / c.sum() * CLASSES).astype(np.int64), CLASSES - 1)
        total = np.bincount(self.of, c, minlength=CLASSES)
        self.logp = np.log(c / total[self.of]).astype(np.float32)


def initial(vocab: int, counts: np.ndarray | None = None) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    d = WIDTH
    f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"E": f(vocab + 1, d), "P": f(WINDOW, d), "A": f(d, 3 * d) * 2, "O": f(d, d) * 2, "C": f(d, CLASSES), "b": np.zeros((1, CLASSES), np.float32)}


_MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)


def forward(m: dict[str, np.ndarray], t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hidden states of windows of ids t, and what the gradient needs."""
    x = m["E"][t] + m["P"]
    qkv = (x.reshape(-1, WIDTH) @ m["A"]).reshape(*t.shape, 3 * WIDTH)
    q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    s = np.matmul(q * np.float32(WIDTH**-0.5), k.transpose(0, 2, 1))
    s += _MASK
    s -= s.max(axis=-1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=-1, keepdims=True)
    o = np.matmul(s, v)
    y = x + (o.reshape(-1, WIDTH) @ m["O"]).reshape(x.shape)
    return y, x, q, k, v, s, o


def exponentials(z: np.ndarray) -> np.ndarray:
    """exp of z in place; the last axis' maximum is taken off first only where some value needs it."""
    if z.max(initial=0) > 60:
        z -= z.max(axis=-1, keepdims=True)
    return np.exp(z, out=z)


def matrices(m: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The matrices of queries, keys and values."""
    return tuple(m["A"][:, i : i + WIDTH] for i in range(0, 3 * WIDTH, WIDTH))


def folded(m: dict[str, np.ndarray]) -> np.ndarray:
    """Side by side the queries' matrix times the keys', scaled, and the values' times the output's: all that attention needs of an input, as what it meets is inputs."""
    query, key, value = matrices(m)
    return np.concatenate([query @ key.T * np.float32(WIDTH**-0.5), value @ m["O"]], axis=1)


def attention(x: np.ndarray, fold: np.ndarray, skip: int = 0) -> tuple[np.ndarray, ...]:
    """What attention adds to the inputs x from place ``skip`` on, and what the gradient needs: the weights, whose rows' sums are still to divide by, one over these sums, and the folded inputs with a column of ones."""
    both = np.empty((*x.shape[:2], 2 * WIDTH + 1), x.dtype)
    both[..., 2 * WIDTH] = 1
    np.matmul(x.reshape(-1, WIDTH), fold, out=both.reshape(-1, 2 * WIDTH + 1)[:, : 2 * WIDTH])
    s = np.matmul(both[:, skip:, :WIDTH], x.transpose(0, 2, 1))
    s += _MASK[skip:]
    exponentials(s)
    # The rows' sums come from the product with the column of ones.
    o = np.matmul(s, both[..., WIDTH:])
    weight = 1 / o[..., WIDTH:]
    return o[..., :WIDTH] * weight, s, weight, both


def gradients(m: dict[str, np.ndarray], t: np.ndarray, target: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean loss of the classes ``target`` at the places ``use``, gradients, and the rows of E that they touch."""
    x = m["E"].take(t, axis=0)
    x += m["P"]
    fold, flat = folded(m), x.reshape(-1, WIDTH)
    o, s, weight, both = attention(x, fold)
    # A last column of ones, which meets the bias.
    y = np.ones((len(flat), WIDTH + 1), x.dtype)
    np.add(flat, o.reshape(-1, WIDTH), out=y[:, :WIDTH])
    z = y @ np.concatenate([m["C"], m["b"]])
    at, u = np.arange(0, z.size, CLASSES) + target.ravel(), use.ravel()
    n = max(1, int(u.sum()))
    picked = z.ravel().take(at)
    if z.max(initial=0) > 60:
        most = z.max(axis=-1)
        z -= most[:, None]
        picked -= most
    np.exp(z, out=z)
    total = z @ np.ones(CLASSES, z.dtype)
    loss = (np.log(total) - picked)[u].sum() / n
    # The gradient of the logits is z times this share of each row, which is taken into the narrower factors.
    z.reshape(-1)[at] -= total
    share = (u / (z.dtype.type(n) * total)).astype(z.dtype)[:, None]
    dy = z @ m["C"].T
    dy *= share
    y *= share
    last = y.T @ z
    do = np.empty((*t.shape, WIDTH + 1), x.dtype)
    np.multiply(dy.reshape(x.shape), weight, out=do[..., :WIDTH])
    np.negative(np.einsum("bwd,bwd->bw", do[..., :WIDTH], o), out=do[..., WIDTH])
    ds = np.matmul(do, both[..., WIDTH:].transpose(0, 2, 1))
    ds *= s
    dboth = np.empty((*t.shape, 2 * WIDTH), x.dtype)
    np.matmul(ds, x, out=dboth[..., :WIDTH])
    np.matmul(s.transpose(0, 2, 1), do[..., :WIDTH], out=dboth[..., WIDTH:])
    dboth = dboth.reshape(-1, 2 * WIDTH)
    dx = np.matmul(ds.transpose(0, 2, 1), both[..., :WIDTH])
    g = {"C": last[:WIDTH], "b": last[WIDTH:]}
    query, key, value = matrices(m)
    dfold = flat.T @ dboth
    product, passed = dfold[:, :WIDTH] * np.float32(WIDTH**-0.5), dfold[:, WIDTH:]
    g["A"] = np.concatenate([product @ key, product.T @ query, passed @ m["O"].T], axis=1)
    g["O"] = value.T @ passed
    dflat = dx.reshape(-1, WIDTH)
    dflat += dboth @ fold.T
    dflat += dy
    g["P"] = dx.sum(axis=0)
    rows = t.ravel()
    # Ids of two bytes are sorted by radix.
    order = np.argsort(rows.astype(np.uint16) if len(m["E"]) <= 1 << 16 else rows, kind="stable")
    rows = rows.take(order)
    opens = np.append(0, np.flatnonzero(rows[1:] != rows[:-1]) + 1)
    # Two columns are one complex number, whose sums are theirs.
    pairs = dflat.take(order, axis=0).view(np.result_type(x.dtype, np.complex64))
    g["E"] = np.add.reduceat(pairs, opens, axis=0).view(x.dtype)
    return float(loss), g, rows[opens]


def windows(ids: np.ndarray, first: np.ndarray, mark: int, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of inputs, targets (0 behind a text's end), the text of each window, and the scored places: each id of each text is a target once."""
    size, stride = np.diff(first), WINDOW - overlap
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // stride)), 0)
    doc = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    # All texts behind one another, each behind a mark: a window's inputs and targets are runs of these.
    marked = np.concatenate([np.insert(ids, first[:-1], mark), np.full(WINDOW, mark, ids.dtype)])
    runs = np.lib.stride_tricks.sliding_window_view(marked, WINDOW)
    start = (first[:-1] + np.arange(len(size)))[doc] + k * stride
    t, target = runs[start], runs[start + 1]
    left = size[doc] - k * stride
    scored = np.arange(WINDOW) < left[:, None]
    short = np.flatnonzero(left < WINDOW)
    t[short] = np.where(scored[short], t[short], mark)
    target[short] = np.where(scored[short], target[short], 0)
    scored[k > 0, :overlap] = False
    return t, target, doc, scored


class Trainer:
    """Adam over the windows of texts as they come; what it has seen besides is one batch of texts."""

    def __init__(self, m: dict[str, np.ndarray], classes: Classes, seed: int, rate: float = 0.01, batch: int = 64) -> None:
        #: Rows of E, of which a step changes some, and all other parameters behind one another: values, means of gradients and those of their squares.
        self.rows, rest = [m["E"].copy(), np.zeros_like(m["E"]), np.zeros_like(m["E"])], [k for k in m if k != "E"]
        value = np.concatenate([m[k].ravel() for k in rest])
        self.rest = [value, np.zeros_like(value), np.zeros_like(value)]
        parts = np.split(value, np.cumsum([m[k].size for k in rest])[:-1])
        self.m = {"E": self.rows[0]} | {k: v.reshape(m[k].shape) for k, v in zip(rest, parts)}
        self.touched = np.zeros(len(m["E"]), bool)
        self.classes, self.random, self.rate, self.batch, self.steps, self.seen = classes, np.random.default_rng(seed), rate, batch, 0, 0

    def take(self, ids: np.ndarray, first: np.ndarray) -> None:
        """Steps over the windows of some texts, which don't overlap here, in a random order."""
        t, target, _, scored = windows(ids, first, len(self.classes.of), 0)
        order = self.random.permutation(len(t))
        self.seen += len(t)
        for i in range(0, len(order), self.batch):
            w = order[i : i + self.batch]
            self.steps += 1
            _, g, rows = gradients(self.m, t.take(w, axis=0), self.classes.of.take(target.take(w, axis=0)), scored.take(w, axis=0))
            self.touched[rows] = True
            some = [x.take(rows, axis=0) for x in self.rows]
            self._adam(*some, g["E"])
            for x, new in zip(self.rows, some):
                x[rows] = new
            self._adam(*self.rest, np.concatenate([g[k].ravel() for k in self.m if k != "E"]))

    def _adam(self, value: np.ndarray, mean: np.ndarray, square: np.ndarray, grad: np.ndarray) -> None:
        n = self.steps
        step, more = np.float32(self.rate / (1 - 0.9**n)), np.float32(1 / (1 - 0.99**n))
        mean *= np.float32(0.9)
        mean += np.float32(0.1) * grad
        square *= np.float32(0.99)
        square += np.float32(0.01) * grad**2
        value -= step * mean / (np.sqrt(square * more) + np.float32(1e-8))


def train_locally(m: dict[str, np.ndarray], classes: Classes, ids: np.ndarray, first: np.ndarray, seed: int, rate: float = 0.01, batch: int = 64) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
    """The windows of some texts, once: the new parameters, the touched rows of E, and the number of windows."""
    trainer = Trainer(m, classes, seed, rate, batch)
    trainer.take(ids, first)
    return trainer.m, np.flatnonzero(trainer.touched), trainer.seen


def hidden(m: dict[str, np.ndarray], t: np.ndarray, skip: int = 0, fold: np.ndarray | None = None) -> np.ndarray:
    """As :func:`forward`, the hidden states alone, from place ``skip`` on, with a column of ones behind them."""
    x = m["E"].take(t, axis=0)
    x += m["P"]
    o = attention(x, folded(m) if fold is None else fold, skip)[0]
    y = np.ones((*o.shape[:2], WIDTH + 1), x.dtype)
    np.add(x[:, skip:], o, out=y[..., :WIDTH])
    return y


def score(m: dict[str, np.ndarray], classes: Classes, ids: np.ndarray, first: np.ndarray, batch: int = 64) -> np.ndarray:
    """Each text's summed negative log probability."""
    t, target, doc, scored = windows(ids, first, len(classes.of))
    out = np.zeros(len(t))
    ones, fold, last = np.ones(CLASSES, np.float32), folded(m), np.concatenate([m["C"], m["b"]])
    # Of a text's later windows, the overlap is context alone.
    opens = np.diff(doc, prepend=-1) > 0
    for skip, some in ((0, np.flatnonzero(opens)), (OVERLAP, np.flatnonzero(~opens))):
        for i in range(0, len(some), batch):
            at = some[i : i + batch]
            goal = target.take(at, axis=0)[:, skip:].ravel()
            z = hidden(m, t.take(at, axis=0), skip, fold).reshape(-1, WIDTH + 1) @ last
            picked = z.ravel().take(np.arange(0, z.size, CLASSES) + classes.of.take(goal))
            if z.max(initial=0) > 60:
                most = z.max(axis=-1)
                z -= most[:, None]
                picked -= most
            loss = np.log(np.exp(z, out=z) @ ones) - picked - classes.logp.take(goal)
            out[at] = loss.reshape(len(at), -1).sum(axis=1, where=scored.take(at, axis=0)[:, skip:], dtype=float)
    return np.bincount(doc, out, minlength=len(first) - 1)


def _kind(vocabulary: tuple[str, str]) -> np.dtype:
    """How an id is stored: in two bytes, if the vocabulary allows it."""
    return np.dtype("<u2" if encoder(*vocabulary).n_vocab <= 1 << 16 else "<u4")


def encoded(docs: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """(doc_id, ids): the subwords of each text, packed; those of a null text are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(vocabulary)
        for batch in batches:
            data, offsets = tw.buffers(batch.column(1), lower=False)
            for i, j in tw.groups(offsets, 1 << 22):
                with tw.at_hand():
                    ids, first = Pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vocabulary).sequence()
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(first.astype(np.int64) * kind.itemsize), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), packed.cast(pa.binary())], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def _ids(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids one after another, and the texts' offsets."""
    data, at = tw.buffers(column, lower=False, kind=pa.large_binary())
    return np.frombuffer(np.ascontiguousarray(data), kind).astype(np.int64), at // kind.itemsize


def subword_counts(texts: DataFrame, kind: np.dtype) -> DataFrame:
    """(id, n): how often each subword occurs in all documents; a task sends each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(_ids(batch.column(0), kind)[0], minlength=len(sums))
            more[: len(sums)] += sums
            sums = more
        ids = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(sums[ids])], names=["id", "n"])

    return texts.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def train_round(sample: DataFrame, model, classes, kind: np.dtype, number: int, rate: float) -> DataFrame:
    """(name, row, part, v0, ...): pieces of parameter rows averaged over partitions, weighted by their windows."""
    names = [f"v{i}" for i in range(COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(model.value, classes.value, number, rate)
        for batch in batches:
            ids, first = _ids(batch.column(0), kind)
            for a, b in tw.groups(first, 1 << 18):
                with tw.at_hand():
                    trainer.take(ids[first[a] : first[b]], first[a : b + 1] - first[a])
        if not trainer.seen:
            return
        for name, v in trainer.m.items():
            at = np.flatnonzero(trainer.touched) if name == "E" else np.arange(len(v))
            for part in range(v.shape[1] // COLUMNS):
                own = v[at, part * COLUMNS : (part + 1) * COLUMNS]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array([float(trainer.seen)] * len(at)), *(pa.array(np.ascontiguousarray(c)) for c in own.T)], names=["name", "row", "part", "w", *names])

    local = sample.mapInArrow(run, "name string, row int, part int, w double, " + ", ".join(f"{c} float" for c in names))
    return local.groupBy("name", "row", "part").agg(*((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in names))


def train(texts: DataFrame, vocabulary: tuple[str, str]):
    """(parameters, classes) fitted to all of the encoded ``texts``."""
    spark = texts.sparkSession
    kind = _kind(vocabulary)
    counts = subword_counts(texts, kind).toArrow()
    vocab = encoder(*vocabulary).n_vocab
    classes = Classes(counts.column("id").to_numpy(), counts.column("n").to_numpy(), vocab)
    m, shared = initial(vocab), spark.sparkContext.broadcast(classes)
    # Each document's place among the shares, by its hash.
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    low = 0.0
    for number, (share, rate) in enumerate(SHARES):
        sent = spark.sparkContext.broadcast(m)
        last = number == len(SHARES) - 1
        got = train_round(texts.where((at >= low) & (F.lit(last) | (at < low + share))).select("ids"), sent, shared, kind, number, rate).toArrow()
        low += share
        m = {k: v.copy() for k, v in m.items()}
        values = np.stack([got.column(f"v{i}").to_numpy() for i in range(COLUMNS)], axis=1)
        name, row, part = np.array(got.column("name").to_pylist(), object), got.column("row").to_numpy(), got.column("part").to_numpy()
        for k in m:
            use = np.flatnonzero(name == k)
            m[k].reshape(len(m[k]), -1, COLUMNS)[row[use], part[use]] = values[use]
        sent.destroy()
    shared.destroy()
    return m, classes


def scores(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, nll, perplexity): the summed negative log probability of each text's subwords, and exp of its mean."""
    spark = docs.sparkSession
    storage.lean(spark)
    vocabulary = vocabulary or default_vocabulary()
    texts = storage.keep(encoded(docs, vocabulary), "ids")
    m, classes = (spark.sparkContext.broadcast(x) for x in train(texts, vocabulary))
    packed = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = _ids(batch.column(1), packed)
            nll, size = np.zeros(batch.num_rows), np.diff(first)
            for a, b in tw.groups(first, 1 << 18):
                with tw.at_hand():
                    nll[a:b] = score(m.value, classes.value, ids[first[a] : first[b]], first[a : b + 1] - first[a])
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                ppl = np.exp(nll / size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(np.round(nll, 4)), pa.array(np.round(ppl, 4), mask=size == 0)], names=["doc_id", "n_tokens", "nll", "perplexity"])

    kind = dict(docs.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, nll double, perplexity double")
