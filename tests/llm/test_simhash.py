import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import simhash as sh
from quillon.llm import textwords as tw

U64 = np.uint64
SCHEMA = "doc_id long, text string, fp int, root string"


def prose(n, seed):
    r = random.Random(seed)
    return [f"word{r.randrange(4000)}" for _ in range(n)]


def brute_print(text):
    w = tw.words(*tw.buffers(pa.array([text])))
    use = [int(h) for h, a, b in zip(w.hash, w.start, w.end) if b - a >= 5] or [int(h) for h in w.hash]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in use) > len(use)) if use else None


def test_fingerprint_is_the_majority():
    texts = ["hello wonderful world", "a b c", "", None, " ".join(prose(900, 1)), "!!!", "Ünïcode strings everywhere"]
    prints, has = sh.fingerprint_batch(pa.array(texts), 5)
    for t, p, h in zip(texts, prints, has):
        want = brute_print(t) if t else None
        assert h == (want is not None)
        # packbits has the lowest of each byte's bits first or last; distances are the same for either.
        if h:
            assert int(p).bit_count() == want.bit_count()


def test_distances_between_fingerprints_are_kept():
    texts = [" ".join(prose(100, i % 7) + prose(i, i)) for i in range(30)]
    prints, _ = sh.fingerprint_batch(pa.array(texts), 5)
    brute = [brute_print(t) for t in texts]
    for i in range(30):
        for j in range(i):
            assert (int(prints[i]) ^ int(prints[j])).bit_count() == (brute[i] ^ brute[j]).bit_count()


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(2000)], U64)
    assert (sh.gray_rank(codes) == np.arange(2000)).all()


@pytest.mark.parametrize("n,distance", [(1, 3), (50, 8), (700, 8), (3000, 3)])
def test_index_against_all_pairs(n, distance):
    r = np.random.default_rng(n)
    base = r.integers(0, 1 << 63, max(1, n // 3), dtype=np.uint64)
    codes = base[r.integers(0, len(base), n)]
    for _ in range(6):
        codes = np.where(r.random(n) < 0.6, codes ^ (U64(1) << r.integers(0, 64, n).astype(U64)), codes)
    codes = np.unique(codes)
    a, b = sh.GrayIndex(codes).near(distance)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert len(got) == len(a)
    i, j = np.triu_indices(len(codes), 1)
    near = np.bitwise_count(codes[i] ^ codes[j]) <= distance
    assert got == set(zip(i[near].tolist(), j[near].tolist()))


def test_blocks():
    for n in (1, 2, 4, 9, 11):
        b = sh.blocks(n)
        assert len(b) == n and sum(w for _, w in b) == 64
    assert [sh.agreeing(n, 8) for n in (0, 10**8, 10**9, 10**10)] == [1, 1, 2, 3]


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_more_blocks_find_the_same(spark, agree):
    r = np.random.default_rng(agree)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(U64(1) << r.integers(0, 64, (k, 60)).astype(U64), axis=0) for k in (1, 2, 4)]))
    t = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    edges = {(x.a, x.b) for x in sh.near_edges(t, 4, agree).collect()}
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    got, want = np.arange(len(codes)), np.arange(len(codes))
    sh.forest(got, *(np.array([at[e[k]] for e in edges], np.int64) for k in (0, 1)))
    i, j = np.triu_indices(len(codes), 1)
    near = np.bitwise_count(codes[i] ^ codes[j]) <= 4
    sh.forest(want, i[near], j[near])
    assert (got == want).all() and near.any()


def fixture():
    base = [prose(200, k) for k in range(12)]
    rows = []
    for k, b in enumerate(base):
        rows.append((k * 100, " ".join(b), 1, "r"))
        for c in range(k % 4):
            d = list(b)
            d[c * 7] = "changed"
            rows.append((k * 100 + c + 1, " ".join(d), 1, "r"))
    rows += [(5000 + i, "exactly the same text here", None, None) for i in range(300)]
    rows += [(9000, None, 1, "r"), (9001, "", 1, "r"), (9002, "!?", 1, "r"), (None, " ".join(base[0]), 1, "r"), (0, " ".join(base[0]), 1, "r"), (9003, " ".join(prose(60000, "x")), 1, "r")]
    return rows


def groups(rows, distance):
    prints = {}
    for i, t, *_ in rows:
        p = brute_print(t) if t else None
        if i is not None and p is not None:
            prints[i] = min(p, prints.get(i, p))
    ids, root = sorted(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= distance:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids if find(i) != i}


def test_groups_against_brute_force(spark):
    rows = fixture()
    t = spark.createDataFrame(rows, SCHEMA)
    want = groups(rows, 8)
    got = {r.doc_id: r.duplicate_of for r in sh.near_duplicates(t).collect()}
    assert got == want and len(want) > 300
    kept = sh.drop_near_duplicates(t)
    assert kept.columns == t.columns
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(r[0]) for r in rows if r[0] not in want)


def test_empty(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert sh.near_duplicates(t).count() == 0 and sh.drop_near_duplicates(t).count() == 0


def test_chain_of_components(spark):
    from quillon.llm import storage

    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {(r.node, r.root) for r in storage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(501, 500)}
