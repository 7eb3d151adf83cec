import random

import pytest

from quillon.llm import suffix_index as sx
from quillon.llm import textwords as tw
import pyarrow as pa

SCHEMA = "doc_id long, text string"


def prose(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def planted():
    shared = [prose(80, "a"), prose(55, "b"), prose(200, "c")]
    docs = {}
    for i in range(40):
        d = prose(150, i)
        for k, s in enumerate(shared):
            if i % (k + 3) == 1:
                at = (i * 13) % 100
                d = d[:at] + s + d[at:]
        docs[i] = d
    docs[100] = list(docs[1])
    docs[101] = list(docs[1])
    docs[102] = prose(40, "q") * 3
    return docs


def runs(docs, n):
    """Words of each document that lie in a run of ``n`` words that is elsewhere too, and in how many places the run is."""
    places = {}
    for i, d in docs.items():
        for p in range(len(d) - n + 1):
            places.setdefault(tuple(d[p : p + n]), []).append((i, p))
    return places


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_all_repeats_are_found(spark, batches):
    docs = planted()
    t = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], SCHEMA)
    found = sx.long_matches(t, batches).collect()
    covered = {i: set() for i in docs}
    for r in found:
        assert 0 <= r.start_word < r.end_word <= len(docs[r.doc_id]) and r.n_words >= sx.SHORTEST
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    repeated = runs(docs, sx.SHORTEST)
    for places in repeated.values():
        missed = [(i, p) for i, p in places if len(places) > 1 and not set(range(p, p + sx.SHORTEST)) <= covered[i]]
        # Of each run just the first to arrive isn't a repeat.
        assert len(missed) <= 1
    # What is nowhere else is in no result, but for a word at the edge by chance.
    cores = runs(docs, sx.CORE)
    for i, words in covered.items():
        inside = {p + k for run, places in cores.items() if len(places) > 1 for j, p in places if j == i for k in range(sx.CORE)}
        assert len(words - inside) <= 2


def test_sampling_depends_on_content_alone():
    words = prose(400, 1)
    a = tw.words(*tw.buffers(pa.array([" ".join(words)])))
    b = tw.words(*tw.buffers(pa.array([" ".join(prose(33, 2) + words[50:300])])))
    x, y = set(sx.sampled(a).tolist()), set((sx.sampled(b) - 33 + 50).tolist())
    inner = range(50 + sx.LEFT, 300 - sx.SHORTEST - sx.LEFT)
    assert {p for p in x if p in inner} == {p for p in y if p in inner}


def test_levels_are_logarithmic():
    import numpy as np

    f = sx.Family()
    for i in range(11):
        w = tw.words(*tw.buffers(pa.array([" ".join(prose(300, i))])))
        at = sx.sampled(w)
        f.add(np.full(len(at), i), at, sx.suffixes(w, at))
    assert [level.batches for level in f.levels] == [8, 2, 1]


def test_odd_input(spark):
    long = " ".join(prose(30000, "l"))
    rows = [(1, None), (2, ""), (3, "short text"), (None, "a " * 200), (4, long), (5, long), (4, long)]
    t = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", batch int, suffix string")
    found = sx.long_matches(t).collect()
    assert {r.doc_id for r in found} <= {4, 5} and any(r.n_words == 30000 for r in found)
    assert sx.long_matches(t.limit(0)).count() == 0


def test_appending_equals_building_at_once(spark):
    from pyspark.sql import functions as F

    docs = planted()
    t = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], SCHEMA)
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    index, got = sx.Index(spark), []
    for b in range(5):
        got += [tuple(r)[:4] for r in index.append(t.where(arrival == b)).collect()]
    want = [tuple(r)[:4] for r in sx.long_matches(t, 5).collect()]
    assert sorted(got) == sorted(want) and want
    sizes = {r.level: r.batch for r in index.levels.select("level", "batch").distinct().collect()}
    assert max(sizes.values()) <= 4 and index.append(t.limit(0)).count() == 0
    # What comes again is found whole.
    again = {r.doc_id: r.n_words for r in index.append(t.where("doc_id < 3")).collect()}
    assert all(again[i] == len(docs[i]) for i in range(3))


def test_copies_are_thinned_before_the_shuffle(spark):
    text = " ".join(prose(300, "h"))
    t = spark.createDataFrame([(i, text) for i in range(500)], SCHEMA).coalesce(1)
    table = sx.suffix_table(t, 4)
    assert table.where("suffix IS NOT NULL").count() * 100 < table.count()
    found = sx.long_matches(t, 4).collect()
    assert len(found) == 499 and all(r.n_words == 300 for r in found)
