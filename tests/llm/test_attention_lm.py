import os

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import attention_lm as lm
from quillon.llm import textwords as tw

SCHEMA = "doc_id long, text string, nll int"


@pytest.fixture(scope="module")
def vocabulary():
    v = lm.default_vocabulary()
    if not os.path.exists(v[0]):
        pytest.skip("the vocabulary isn't here")
    return v


def test_pieces_are_the_whole_texts_ids(vocabulary):
    texts = ["Hello world, it's  fine!\n\n  Yes 123 ok ", "", "ünïcode — straße 你好", "   ", "a", "tab\tand\r\nlines  "]
    data, offsets = tw.buffers(pa.array(texts), lower=False)
    ids, first = lm.Pieces(data, offsets, vocabulary).sequence()
    enc = lm.encoder(*vocabulary)
    for i, t in enumerate(texts):
        assert enc.decode(ids[first[i] : first[i + 1]].tolist()) == t
    same = [enc.encode_ordinary(t) == ids[first[i] : first[i + 1]].tolist() for i, t in enumerate(texts)]
    assert same[4] and same[2] and same[1]
    which, n = lm.Pieces(data, offsets, vocabulary).counts()
    assert n.sum() == len(ids) and set(which) == set(ids)


def test_pieces_of_equal_polynomials_keep_their_own_ids(vocabulary):
    """Thue-Morse words of 2,048 letters and their complements agree in every polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    texts = ["x " + word, "x " + word.translate({97: 98, 98: 97})]
    ids, first = lm.Pieces(*tw.buffers(pa.array(texts), lower=False), vocabulary).sequence()
    enc = lm.encoder(*vocabulary)
    assert [enc.decode(ids[first[i] : first[i + 1]].tolist()) for i in range(2)] == texts


def test_distinct_pieces_are_encoded_in_one_go(vocabulary, monkeypatch):
    """One call for all pieces that can stand behind one another, and one for each distinct piece that opens a text or is white space to its end."""
    real, calls = lm.encoder(*vocabulary), []

    class Counted:
        n_vocab, token_byte_values, encode_single_token = real.n_vocab, real.token_byte_values, real.encode_single_token

        def encode_ordinary(self, text):
            calls.append(text)
            return real.encode_ordinary(text)

    monkeypatch.setattr(lm, "encoder", lambda *_: Counted())
    odd = ["", "ends in blanks  ", "  ", "no\u00a0break\u00a0 \u3000 \u2003\u3000x\u0085\n\u0085 y", "été\u00a0\u00a0  là", "\r\n\t.\n\n!  '\x1c s"]
    texts = ["one " + " ".join(f"w{i * k % 977}q" for i in range(300)) for k in range(1, 9)] + odd
    ids, first = lm.Pieces(*tw.buffers(pa.array(texts), lower=False), vocabulary).sequence()
    assert len(calls) < 30
    for i, text in enumerate(texts):
        if text not in odd:
            assert ids[first[i] : first[i + 1]].tolist() == real.encode_ordinary(text)
        assert real.decode(ids[first[i] : first[i + 1]].tolist()) == text


@pytest.mark.parametrize("sizes", [[0], [1], [32, 33, 31], [24, 56, 57, 1000], [0, 5, 0]])
def test_each_token_is_scored_once(sizes):
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.arange(first[-1], dtype=np.int32)
    t, target, doc, scored = lm.windows(ids, first, 10**6)
    assert sorted(target[scored].tolist()) == ids.tolist()
    for w in range(len(t)):
        own = first[doc[w]]
        for k in np.flatnonzero(scored[w]):
            x = target[w, k]
            assert t[w, k] == (x - 1 if x > own else 10**6)
            assert k >= min(lm.OVERLAP, x - own)


def tiny(vocab=40):
    rng = np.random.default_rng(5)
    classes = lm.Classes(np.arange(vocab), rng.integers(1, 100, vocab), vocab)
    m = lm.initial(vocab)
    return {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.2 for k, v in m.items()}, classes


def slow_scores(m, classes, row):
    """One window at a time and one place at a time, from the definition."""
    d = lm.WIDTH
    x = m["E"][row].astype(float) + m["P"]
    out = []
    for i in range(len(row)):
        q = x[i] @ m["A"][:, :d]
        k, v = x[: i + 1] @ m["A"][:, d : 2 * d], x[: i + 1] @ m["A"][:, 2 * d :]
        s = np.exp(k @ q / np.sqrt(d))
        y = x[i] + (s / s.sum()) @ v @ m["O"]
        z = y @ m["C"] + m["b"][0]
        out.append(z - np.log(np.exp(z).sum()))
    return np.array(out)


def test_scores_against_definition():
    m, classes = tiny()
    ids = np.random.default_rng(1).integers(0, 40, 150).astype(np.int32)
    first = np.array([0, 100, 100, 150])
    got = lm.score(m, classes, ids, first, batch=3)
    t, target, doc, scored = lm.windows(ids, first, 40)
    want = np.zeros(3)
    for w in range(len(t)):
        lp = slow_scores(m, classes, t[w])
        for k in np.flatnonzero(scored[w]):
            want[doc[w]] -= lp[k, classes.of[target[w, k]]] + classes.logp[target[w, k]]
    assert got == pytest.approx(want, rel=1e-4)


def test_gradients_by_differences():
    m, classes = tiny()
    m = {k: v.astype(np.float64) for k, v in m.items()}
    rng = np.random.default_rng(2)
    t, target = rng.integers(0, 40, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW))
    use = rng.random((3, lm.WINDOW)) < 0.8
    _, g, rows = lm.gradients(m, t, target, use)
    for name in m:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in m[name].shape)
            if name == "E":
                at = (int(rng.choice(rows)), at[1])
            old, step = m[name][at], 1e-4
            m[name][at] = old + step
            up = lm.gradients(m, t, target, use)[0]
            m[name][at] = old - step
            down = lm.gradients(m, t, target, use)[0]
            m[name][at] = old
            mine = g[name][int(np.searchsorted(rows, at[0])), at[1]] if name == "E" else g[name][at]
            assert mine == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-5)


def test_gradients_of_large_logits():
    m, classes = tiny()
    m["C"] *= 300
    rng = np.random.default_rng(8)
    t, target, use = rng.integers(0, 40, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW)), rng.random((3, lm.WINDOW)) < 0.8
    loss, g, _ = lm.gradients(m, t, target, use)
    exact, want, _ = lm.gradients({k: v.astype(np.float64) for k, v in m.items()}, t, target, use)
    assert loss == pytest.approx(exact, rel=1e-4)
    for name in m:
        assert g[name] == pytest.approx(want[name], rel=1e-3, abs=1e-4 * np.abs(want[name]).max())


def test_training_lowers_the_loss():
    rng = np.random.default_rng(3)
    _, classes = tiny()
    m = lm.initial(40)
    ids = (np.cumsum(rng.integers(1, 3, 20000)) % 40).astype(np.int32)
    first = np.arange(0, 20001, 500)
    before = lm.score(m, classes, ids, first).sum()
    trained, _, n = lm.train_locally(m, classes, ids, first, 0, batch=8)
    assert n > 0 and lm.score(trained, classes, ids, first).sum() < 0.8 * before


def test_later_windows_leave_their_overlap_out():
    m, _ = tiny()
    t = np.random.default_rng(6).integers(0, 40, (5, lm.WINDOW))
    assert lm.hidden(m, t, lm.OVERLAP) == pytest.approx(lm.hidden(m, t)[:, lm.OVERLAP :], rel=1e-5, abs=1e-6)


def test_steps_take_no_new_pages():
    """Steps make the same arrays again and again; their room is kept meanwhile."""
    import resource

    ids = np.random.default_rng(7).integers(0, 40, 64 * lm.WINDOW * 200)
    faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    with tw.at_hand():
        lm.train_locally(*tiny(), ids[:200_000], np.array([0, 200_000]), 0)
        before = faults()
        lm.train_locally(*tiny(), ids, np.array([0, len(ids)]), 0)
        assert faults() - before < 200 * 40


def test_class_probabilities_sum_to_one():
    _, classes = tiny()
    total = np.bincount(classes.of, np.exp(classes.logp), minlength=lm.CLASSES)
    assert total[total > 0] == pytest.approx(np.ones((total > 0).sum()), rel=1e-5)


def test_column(spark, vocabulary):
    words = "the house of green stones by the river where light falls on water".split()
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, prose(80), 1) for i in range(100)] + [(200, None, 1), (201, "", 1), (None, prose(30), 1), (0, "again", 1), (202, prose(30000), 1), (203, "zxq qzk " * 40, 1)]
    t = spark.createDataFrame(rows, SCHEMA)
    out = lm.scores(t, vocabulary).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    enc = lm.encoder(*vocabulary)
    assert by[202].n_tokens == len(enc.encode_ordinary([r for r in rows if r[0] == 202][0][1]))
    assert by[200].perplexity is None and by[201].n_tokens == 0 and by[203].perplexity > 2 * by[1].perplexity
    assert lm.scores(t.limit(0), vocabulary).count() == 0
