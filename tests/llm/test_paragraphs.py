import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import paragraphs as pg
from quillon.llm import textwords as tw

SCHEMA = "doc_id long, text string, n_chars int, __id int, pid string"
REACH, MIN = 8, 8


def prose(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def fixture():
    shared = prose(60, "s")
    near = list(shared)
    near[30] = "other"
    rows = []
    for i in range(30):
        body = prose(120, i)
        if i % 3 == 0:
            body = body[:40] + ["\n"] + (shared if i % 2 else near) + ["\n"] + body[40:]
        rows.append((i, " ".join(body)))
    rows += [(100, " ".join(prose(120, 1))), (101, None), (102, ""), (103, "a b c"), (None, " ".join(shared)), (3, rows[3][1]), (104, " ".join(prose(20000, "x"))), (105, "Ünïcode İstanbul straße " * 4 + "\n" + " ".join(shared))]
    return [(*r, 1, 2, "p") for r in rows]


def pieces(text):
    p = pg.Paragraphs(tw.words(*tw.buffers(pa.array([text]))), REACH, MIN)
    grams, first = p.shingles()
    return [(int(k), int(i), frozenset((grams[a:b] >> np.uint64(32)).tolist())) for k, i, a, b in zip(p.position, p.ids().view(np.int64), first[:-1], first[1:])]


def brute(rows, threshold=0.8):
    """Components over all pairs of paragraphs."""
    own = {}
    for i, t, *_ in rows:
        if i is not None and t:
            for k, p, g in pieces(t):
                own[i, k] = (p, g)
    sets = {p: g for p, g in own.values()}
    root = {p: p for p in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for place, (p, _) in own.items():
        groups.setdefault(find(p), []).append(place)
    return {(place, min(g)) for g in groups.values() for place in g if place != min(g)}


def test_against_brute_force(spark):
    rows = fixture()
    got = {((r.doc_id, r.position), (r.duplicate_of, r.duplicate_position)) for r in pg.repeats(spark.createDataFrame(rows, SCHEMA), min_run=1).collect()}
    want = brute(rows)
    found = {g for g, _ in got}
    missed = {w for w, _ in want} - found
    assert len(missed) <= 0.1 * len(want) and not found - {w for w, _ in want} and len(want) > 20


def test_texts_without_repeats(spark):
    rows = fixture()
    t = spark.createDataFrame(rows, SCHEMA)
    gone = {}
    for r in pg.repeats(t, min_run=1).collect():
        gone.setdefault(r.doc_id, set()).add(r.position)
    out = pg.without_repeats(t, min_run=1)
    assert out.columns == t.columns and out.count() == len(rows)
    for r in out.collect():
        texts = [x[1] for x in rows if x[0] == r.doc_id]
        if r.doc_id not in gone:
            assert r.text in texts
        else:
            left = tw.words(*tw.buffers(pa.array([texts[0]])))
            p = pg.Paragraphs(left, REACH, 0)
            want = np.concatenate([left.hash[a:b] for k, (a, b) in enumerate(zip(p.starts, p.ends)) if k not in gone[r.doc_id]] or [left.hash[:0]])
            assert (tw.words(*tw.buffers(pa.array([r.text]))).hash == want).all()
    assert out.where("doc_id = 105").first().text.startswith("Ünïcode İstanbul")
    # What is left of a copy is too short a paragraph to go.
    assert len(out.where("doc_id = 100").first().text.split()) < MIN


def test_cuts_depend_on_near_words_alone():
    s = " ".join(prose(200, "q"))
    a, b = {p for _, p, _ in pieces(s)}, {p for _, p, _ in pieces("x y z " + s + " u v w")}
    assert len(a & b) >= len(a) - 2


@pytest.mark.parametrize("threshold,recall", [(0.5, 0.9), (0.8, 0.95), (0.9, 0.99)])
def test_tuning(threshold, recall):
    bands, rows = pg.tune_bands(threshold, recall, 20)
    assert 1 - (1 - threshold**rows) ** bands >= recall and bands <= 20


def test_empty(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert pg.repeats(t).count() == 0 and pg.without_repeats(t).count() == 0
    none = spark.createDataFrame([(None, None, 1, 1, "x"), (1, None, 1, 1, "x")], SCHEMA)
    assert pg.without_repeats(none).where(F.col("text").isNull()).count() == 2


def test_sieve(spark):
    from quillon.llm import sieve

    keys = spark.range(0, 50000, 3).withColumnRenamed("id", "k")
    s = sieve.of(keys.union(spark.sql("SELECT CAST(NULL AS long)")), "k").value
    every = np.arange(50000)
    has = s.has(every)
    assert has[::3].all() and has.mean() < 0.36
    assert not sieve.of(keys.limit(0), "k").value.has(every).any()


def test_near_copies_of_natural_paragraphs_go_whole(spark):
    """Paragraphs of 100 words with 3 changed, as lines of their own: recall against brute force over the lines."""
    r = random.Random(8)
    rows, copies = [], 0
    for i in range(40):
        p = prose(100, f"n{i}")
        rows.append((i, "\n".join([" ".join(prose(50, f"a{i}")), " ".join(p), " ".join(prose(50, f"b{i}"))]), 1, 2, "p"))
        for k in r.sample(range(5, 95), 3):
            p[k] = "changed"
        rows.append((100 + i, "\n".join([" ".join(prose(50, f"c{i}")), " ".join(p)]), 1, 2, "p"))
    t = spark.createDataFrame(rows, SCHEMA)
    lines = {(i, k): set(zip(x.split(), x.split()[1:], x.split()[2:])) for i, text, *_ in rows for k, x in enumerate(text.split("\n"))}
    want = {b[0] for a, b in combinations(sorted(lines), 2) if len(lines[a] & lines[b]) >= 0.8 * len(lines[a] | lines[b])}
    assert len(want) == 40
    left = {x.doc_id: x.text.split() for x in pg.without_repeats(t, natural=True).collect()}
    whole = {i for i in want if len(left[i]) == 50}
    assert len(whole) >= 0.9 * len(want)
    assert all(len(left[i]) == 200 for i in range(40)) and all(len(left[i]) in (50, 150) or i in want for i in range(100, 140))


def test_what_goes_with_a_paragraph_stays_elsewhere(spark):
    """A changed passage in a near copy that goes whole isn't also taken from the document that quotes it."""
    p = prose(150, "whole")
    q = p[:60] + prose(12, "quote") + p[72:]
    rows = [(1, " ".join(p), 1, 2, "p"), (2, " ".join(q), 1, 2, "p"), (3, " ".join(prose(40, "x") + q[50:82] + prose(40, "y")), 1, 2, "p")]
    left = {x.doc_id: x.text for x in pg.without_repeats(spark.createDataFrame(rows, SCHEMA), natural=True).collect()}
    assert left[2] == "" and " ".join(q[60:72]) in left[3]


@pytest.mark.parametrize("natural", [False, True])
def test_passages_in_short_lines(spark, natural):
    """Verse: 80 words in lines of 5 recur between other text and between other short lines."""
    words = prose(80, "verse")
    verse = "\n".join(" ".join(words[k : k + 5]) for k in range(0, 80, 5))
    near = lambda seed: "\n".join(" ".join(prose(4, f"{seed}{k}")) for k in range(6))
    rows = [(1, " ".join(prose(40, "l")) + "\n" + verse + "\n" + " ".join(prose(40, "m"))), (2, verse), (3, near("a") + "\n" + verse + "\n" + near("b"))]
    t = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], SCHEMA)
    left = {x.doc_id: x.text for x in pg.without_repeats(t, natural=natural).collect()}
    assert left[1] == rows[0][1] and left[2] == ""
    kept = set(left[3].split())
    assert len(kept & set(words)) < 40 and set(near("a").split()[:10]) <= kept


def test_no_remainders():
    for seed in range(20):
        p = pg.Paragraphs(tw.words(*tw.buffers(pa.array(["\n".join(" ".join(prose(n, f"{seed}{n}")) for n in (30, 50, 9, 200))]))), REACH, 0)
        assert (p.ends - p.starts).min() >= MIN


def test_rows_of_one_document_with_other_texts_lose_only_their_own(spark):
    p, a, b = (" ".join(prose(60, x)) for x in "pab")
    t = spark.createDataFrame([(1, p, 1, 2, "p"), (2, p + "\n" + a, 1, 2, "p"), (2, b + "\n" + a, 1, 2, "p"), (3, b, 1, 2, "p")], SCHEMA)
    left = {(r.doc_id, i): r.text.strip() for i, r in enumerate(pg.without_repeats(t, natural=True).orderBy("doc_id", "text").collect())}
    texts = [x for (d, _), x in left.items() if d == 2]
    # a stays in one of the two rows of document 2, b goes from document 3 and p from the first row of 2.
    assert left[1, 0] == p and sum(x.count(a) for x in texts) == 1 and sum(x.count(b) for x in left.values()) == 1 and sum(x.count(p) for x in left.values()) == 1


def test_short_runs_stay(spark):
    line, passage = " ".join(prose(10, "l")), " ".join(prose(60, "q"))
    rows = [(i, line + "\n" + " ".join(prose(80, f"d{i}")) + "\n" + (passage if i > 2 else ""), 1, 2, "p") for i in range(5)]
    left = {r.doc_id: r.text for r in pg.without_repeats(spark.createDataFrame(rows, SCHEMA), natural=True).collect()}
    assert all(line in x for x in left.values()) and sum(passage in x for x in left.values()) == 1
    left = {r.doc_id: r.text for r in pg.without_repeats(spark.createDataFrame(rows, SCHEMA), natural=True, min_run=1).collect()}
    assert sum(line in x for x in left.values()) == 1


@pytest.mark.parametrize("salted", [4096, 3])
def test_bands_lose_no_link(spark, monkeypatch, salted):
    """Chains, cliques and strangers in one band have the components that all pairs give."""
    monkeypatch.setattr(pg, "SALTED", salted)
    r = random.Random(5)
    sets = {}
    for base in range(3):
        own = list(range(base * 1000, base * 1000 + 40))
        for k in range(12):
            # Each step of the chain leaves one member and takes a new one.
            own = [*own[1:], base * 1000 + 100 + k]
            sets[len(sets) + 1] = sorted(own)
    ids = list(sets)
    r.shuffle(ids)
    sets = {new: sets[old] for new, old in zip(ids, sorted(sets))}
    grams = spark.createDataFrame(list(sets.items()), "pid long, grams array<long>")
    members = spark.createDataFrame([(7, i) for i in sets] + [(8, 1), (8, 2)], "band long, pid long")
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = set(sets[a]), set(sets[b])
        if len(x & y) >= 0.8 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for i in sets if find(i) != i}
    assert want and {x.node: x.root for x in pg.linked(members, grams, 0.8).collect()} == want


def test_hot_bands_compare_few_pairs_and_lose_none(spark, monkeypatch):
    """Of a hot band's unlike sets that share their commonest trigrams few are compared, and all similar ones are found."""
    r = random.Random(8)
    sets, real, asked = {}, pg.similar, []
    for k in range(150):
        n = r.choice([6, 10, 18, 40])
        sets[2 * k] = sorted({1, 2, 3, *range(100 + 50 * k, 100 + 50 * k + n - 3)})
        # A copy, of which some trigrams differ: about as many as a pair at the threshold may have.
        other = [x for x in sets[2 * k] if x < 4 or r.random() > 0.1]
        sets[2 * k + 1] = sorted({*other, *(10_000_000 + 100 * k + j for j in range(r.choice([0, 1, 2])))})
    want = {2 * k + 1: 2 * k for k in range(150) if len({*sets[2 * k]} & {*sets[2 * k + 1]}) >= 0.8 * len({*sets[2 * k]} | {*sets[2 * k + 1]})}

    def similar(pairs, grams, threshold):
        asked.append(pairs.count())
        return real(pairs, grams, threshold)

    monkeypatch.setattr(pg, "similar", similar)
    grams = spark.createDataFrame(list(sets.items()), "pid long, grams array<long>")
    got = {x.node: x.root for x in pg.linked(spark.createDataFrame([(7, i) for i in sets], "band long, pid long"), grams, 0.8).collect()}
    assert 30 < len(want) < 140 and got == want
    # All pairs of what the first comparison leaves over would be 44,551.
    assert sum(asked) < 2000


def test_variants_of_one_text_are_joined_without_a_comparison_a_pair(spark, monkeypatch):
    """Sets of one core with some trigrams more or less: their similar pairs grow as the square, those that are compared don't."""
    monkeypatch.setattr(pg, "MANY", 500, raising=False)
    r = random.Random(5)
    sets, real, asked = {}, pg.similar, []
    for k in range(600):
        lost = r.choice([0, 0, 1, 2])
        sets[k] = sorted({*range(1, 21 - lost), *(1000 + 10 * k + j for j in range(r.choice([0, 1, 2, 3, 4, 5, 6])))})
    pairs = [(a, b) for a in sets for b in range(a) if 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})]
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a, b in pairs):
            break

    def similar(pairs, grams, threshold):
        asked.append(pairs.count())
        return real(pairs, grams, threshold)

    monkeypatch.setattr(pg, "similar", similar)
    grams = spark.createDataFrame([(k, v) for k, v in sets.items()], "pid long, grams array<long>")
    # The band's least, which all meet first, is like none of them.
    members = spark.createDataFrame([(7, k) for k in [-1, *sets]], "band long, pid long")
    grams = grams.union(spark.createDataFrame([(-1, list(range(-50, -20)))], "pid long, grams array<long>"))
    got = {x.node: x.root for x in pg.linked(members, grams, 0.8).collect()}
    assert got == {k: x for k, x in root.items() if x != k} and len(pairs) > 20_000
    assert sum(asked) < 4000, asked


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_long_chains_settle(spark, few):
    from quillon.llm import storage

    edges = spark.range(3000).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(5000, 5000), (None, 3), (9000, 8000), (8500, 9000)], "a long, b long"))
    got = {x.node: x.root for x in storage.components(edges, few).collect()}
    assert got == {**dict.fromkeys(range(1, 3001), 0), 9000: 8000, 8500: 8000}
    assert storage.components(edges.limit(0), few).count() == 0


def test_only_kept_tables_are_dropped(spark, tmp_path):
    from quillon.llm import storage

    path = tmp_path / "quillon" / "sf" / "documents.parquet"
    spark.range(3).write.parquet(str(path))
    spark.range(3).write.parquet(str(tmp_path / "quillon" / "sf" / "labels.parquet"))
    t = spark.read.parquet(str(path))
    storage.drop(t)
    assert t.count() == 3 and path.exists()
    kept = storage.keep(t, "t")
    assert kept.count() == 3
    storage.drop(kept)
    storage.drop(kept)
    assert (tmp_path / "quillon" / "sf" / "labels.parquet").exists()
