import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import language_id as li
from quillon.llm import textwords as tw

STEMS = {"aa": "the and ing tion of that", "bb": "der die und sch ung ein", "cc": "que los cion ado una por", "dd": "eau les oux une est ment", "ee": "ij oo een het van aar"}
SCHEMA = "doc_id long, lang string, text string, gap int, predicted int"


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    parts = STEMS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def rows(langs, n):
    return [(k * 1000 + i, lang, prose(lang, 20 + i % 50, i), 1, 2) for k, lang in enumerate(langs) for i in range(n)]


def test_codewords_are_apart():
    for k in range(2, 12):
        code = li.codewords(k)
        least = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        assert code.shape[0] == k and least >= (2 ** (k - 2) if k <= 6 else 3)
        assert ((code.max(axis=0) > 0) & (code.min(axis=0) < 0)).all()


def test_held_out_accuracy():
    langs = list(STEMS)
    train = rows(langs, 60)
    coder = li.fit([r[2] for r in train], [r[1] for r in train])
    test = [(lang, prose(lang, 15, f"t{i}")) for lang in langs for i in range(60)]
    best, _ = coder.decode(coder.margins(*tw.buffers(pa.array([t for _, t in test]))))
    assert np.mean([coder.langs[b] == lang for b, (lang, _) in zip(best, test)]) > 0.97


def test_decoding_is_the_least_weighted_loss():
    train = rows(list(STEMS), 20)
    coder = li.fit([r[2] for r in train], [r[1] for r in train])
    m = np.random.default_rng(1).normal(size=(50, coder.code.shape[1]))
    best, gap = coder.decode(m)
    for i in range(50):
        losses = [sum(w * np.log1p(np.exp(-c * x)) for w, c, x in zip(coder.weight, word, m[i])) for word in coder.code]
        order = sorted(losses)
        assert best[i] == losses.index(order[0]) and gap[i] == pytest.approx((order[1] - order[0]) / coder.weight.sum())


def test_features_by_hand():
    data, first = tw.buffers(pa.array(["abcd", "", "ab", "xyz"]))
    bucket, at = li.features(data, first)
    assert np.diff(at).tolist() == [2, 0, 1, 1] and len(bucket) == 4


def test_column(spark):
    r = rows(["aa", "bb", "cc", "dd"], 60)
    mixed = prose("aa", 40, 1) + " " + prose("bb", 40, 1)
    odd = [(9000, "aa", None, 1, 2), (9001, "aa", "", 1, 2), (9002, None, prose("bb", 50, "n"), 1, 2), (None, "cc", prose("cc", 50, "n"), 1, 2), (0, "aa", r[0][2], 1, 2), (9003, "aa", "  \n", 1, 2), (9004, None, prose("dd", 100000, "l"), 1, 2), (9005, None, mixed, 1, 2)]
    t = spark.createDataFrame(r + odd, SCHEMA)
    out = li.identify(t).collect()
    assert len(out) == len(r) + len(odd)
    by = {x.doc_id: x for x in out}
    assert np.mean([by[x[0]].predicted == x[1] for x in r]) > 0.98
    assert by[9002].predicted == "bb" and by[None].predicted == "cc" and by[9004].predicted == "dd"
    for k in (9000, 9001, 9003):
        assert by[k].predicted is None and by[k].ambiguous
    assert by[9005].gap < np.median([by[x[0]].gap for x in r])


def test_few_languages(spark):
    t = spark.createDataFrame(rows(["aa"], 20), SCHEMA)
    assert {r.predicted for r in li.identify(t).collect()} == {"aa"}
    assert li.identify(t.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, "text here", 1, 2)], SCHEMA)
    assert li.identify(none).first().predicted is None
