import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import kneser_ney as kn

DOCS, LABELS = "doc_id long, lang string, text string, extra int, __text string", "doc_id long, quality int, toxic int"
WORDS = "the of and house garden river stone light water green window letter morning".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


def corpus():
    rows = [(i, "en", prose(60, i), 1, "z") for i in range(200)]
    rows += [(1000 + i, "en", "".join(random.Random(i).choice("#%&qxz$@!~^") for _ in range(300)), 1, None) for i in range(20)]
    rows += [(2000, None, "no language", 1, None), (2001, "xx", "unknown language", 1, None), (2002, "en", None, 1, None), (2003, "en", "", 1, None), (None, "en", prose(20, 9), 1, None), (0, "en", prose(60, 0), 1, "z"), (2004, "en", prose(20000, 4), 1, None)]
    labels = [(i, 1, 0) for i in range(150)] + [(1000, 0, 0), (5, None, None), (9999, 1, 0), (3, 1, 0), (2002, 1, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    return docs, kn.train(docs, spark.createDataFrame(labels, LABELS), shard_entries=500), rows


def brute_model(texts):
    """Interpolated modified Kneser-Ney over bytes, from the definition."""
    order = kn.ORDER
    counts = [None] + [defaultdict(int) for _ in range(order)]
    for t in texts:
        b = bytes([kn._BEFORE] * (order - 1)) + t.encode()
        for i in range(order - 1, len(b)):
            counts[order][b[i - order + 1 : i + 1]] += 1
    for n in range(1, order):
        for g in {g[-(n + 1) :] for g in counts[order]}:
            counts[n][g[1:]] += 1
    discount = {}
    for n in range(1, order + 1):
        c = Counter(counts[n].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0.5
        discount[n] = [max(0.05, min(k - 0.05, k - (k + 1) * y * c[k + 1] / c[k])) if c[k] and c[k + 1] else 0.5 for k in (1, 2, 3)]
    totals = [None] + [defaultdict(lambda: [0, 0.0]) for _ in range(order)]
    cut = lambda n, c: min(c, discount[n][min(c, 3) - 1])
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            totals[n][g[:-1]][0] += c
            totals[n][g[:-1]][1] += cut(n, c)

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        if g[:-1] not in totals[n]:
            return p(g[1:])
        total, mass = totals[n][g[:-1]]
        c = counts[n].get(g, 0)
        return (c - (cut(n, c) if c else 0)) / total + mass / total * p(g[1:])

    return p


def test_against_definition(spark):
    texts = ["abracadabra", "abra cadabra", "banana band", "über"]
    import pyarrow as pa

    from quillon.llm import textwords as tw

    t = spark.createDataFrame([("en", x) for x in texts], "lang string, text string")
    table = kn.model_table(t.mapInArrow(kn._count, "lang string, gram long, c long"))
    p = brute_model(texts)
    for size in (10**6, 20):
        shards = list(kn.compiled(table, size))
        assert len(shards) > 1 or size > 20
        for x in ["abra", "bandana", "zzz", "ü", "abracadabra band"]:
            data, offsets = tw.buffers(pa.array([x]), lower=False)
            got = sum(kn.score_batch(m, ["en"], data, offsets, s, of)[0] for m, s, of in shards)
            b = bytes([kn._BEFORE] * (kn.ORDER - 1)) + x.encode()
            want = sum(math.log(p(b[i - kn.ORDER + 1 : i + 1])) for i in range(kn.ORDER - 1, len(b)))
            assert got == pytest.approx(want, rel=1e-5)
    # All bytes' chances sum to 1.
    assert sum(p(b"abra" + bytes([c])) for c in range(256)) == pytest.approx(1)


def test_decisions(trained):
    docs, model, rows = trained
    out = model.scored(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[1000 + i].rejected for i in range(20))
    assert sum(by[i].rejected for i in range(200)) <= 4 and not by[2004].rejected
    for k in (2000, 2001, 2002, 2003):
        assert by[k].perplexity is None and not by[k].rejected


def test_kept_agrees_and_keeps_columns(trained):
    docs, model, rows = trained
    kept = model.kept(docs)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in model.scored(docs).where("rejected").collect()}
    assert kept.count() == len([r for r in rows if r[0] not in bad])
    assert {r["__text"] for r in kept.where("doc_id = 0").collect()} == {"z"}


def test_all_trusted_text_is_counted_or_held_out(spark, monkeypatch):
    rows = [(i, "en", f"document {i} of many", 1, None) for i in range(4000)] + [(5000 + i, "fr", f"texte {i}", 1, None) for i in range(2)]
    seen, real = [], kn.model_table

    def model_table(counts):
        seen.append({r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).collect()})
        return real(counts)

    monkeypatch.setattr(kn, "model_table", model_table)
    model = kn.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(r[0], 1, 0) for r in rows], LABELS))
    size = sum(len(r[2]) for r in rows if r[1] == "en")
    assert 0.75 * size < seen[0]["en"] < 0.85 * size and seen[0]["fr"] == len("texte 0")
    assert set(model.limits) == {"en", "fr"}


def test_tasks_sum_counts():
    import numpy as np
    import pyarrow as pa

    texts = [prose(30000, i) for i in range(12)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(texts[i : i + 3])], names=["lang", "text"]) for i in range(0, 12, 3)]
    out = pa.Table.from_batches(kn._count(iter(batches)))
    gram, c = out.column("gram").to_numpy(), out.column("c").to_numpy()
    assert len(np.unique(gram)) == len(gram) and c.sum() == sum(map(len, texts))


def test_without_labels(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    model = kn.train(docs, spark.createDataFrame([], LABELS))
    assert model.kept(docs).count() == len(rows) and model.scored(docs).where(F.col("perplexity").isNotNull()).count() == 0
    none = docs.limit(0)
    assert kn.train(none, spark.createDataFrame([], LABELS)).scored(none).count() == 0
