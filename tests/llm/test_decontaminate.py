import random

import numpy as np
import pyarrow as pa

from quillon.llm import decontaminate as dc
from quillon.llm import textwords as tw

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string, doc_id int"


def prose(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


def hashes(words):
    return tw.words(*tw.buffers(pa.array([" ".join(words)]))).hash


def brute(pattern, text):
    """Least edit distance of a pattern to any substring, by the table."""
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (p != t)))
        before = row
    return min(before)


def test_myers():
    r = random.Random(3)
    for _ in range(300):
        a, b = [r.randrange(4) for _ in range(r.randrange(1, 90))], [r.randrange(4) for _ in range(r.randrange(0, 120))]
        d, end = dc.myers(np.array(a), np.array(b, dtype=np.int64))
        assert d == brute(a, b)
        assert brute(a, b[:end]) == d


def edited(words, n, seed):
    r, out = random.Random(seed), list(words)
    for _ in range(n):
        k = r.randrange(len(out))
        how = r.randrange(3)
        if how == 0:
            out[k] = "changed"
        elif how == 1:
            del out[k]
        else:
            out.insert(k, "added")
    return out


def fixture():
    items = [(i, prose(10 + 9 * i, f"i{i}")) for i in range(12)] + [(50, ["too", "short"])]
    docs = []
    for i in range(60):
        d = prose(200, i)
        if i % 2:
            k = (i // 2) % 12
            d = d[:50] + edited(items[k][1], i % 5, i) + d[50:]
        docs.append((i, d))
    docs += [(200, items[3][1]), (201, items[4][1] * 3), (202, prose(30000, "long") + items[5][1])]
    return items, docs


def test_search_is_exact(spark):
    items, docs = fixture()
    rows = [(i, " ".join(d), 1) for i, d in docs] + [(300, None, 1), (301, "", 1), (None, " ".join(items[2][1]), 1), (200, " ".join(items[3][1]), 1)]
    bench = [(i, " ".join(w), 1) for i, w in items] + [(None, "x " * 20, 1), (60, None, 1), (61, "", 1), (3, " ".join(items[3][1]), 1)]
    t, b = spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, ITEMS)
    want = {}
    for i, d in docs:
        text = hashes(d).tolist()
        for k, w in items:
            m = len(w)
            if m >= 8 and len(text) < 5000:
                distance = brute(hashes(w).tolist(), text)
                if distance <= dc.budget(m, 0.1):
                    want[i, k] = distance
    found = dc.contaminated(t, b)
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect() if r.doc_id is not None and r.doc_id != 202}
    assert got == want and len(want) > 15
    assert (202, 5) in {(r.doc_id, r.item_id) for r in found.collect()}
    # Pieces in several parts find the same.
    small = {(r.doc_id, r.item_id): r.distance for r in dc.contaminated(t, b, most_pieces=5).collect() if r.doc_id is not None and r.doc_id != 202}
    assert small == want
    kept = dc.drop_contaminated(t, b)
    assert kept.columns == t.columns
    bad = {i for i, _ in want} | {202}
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in bad)


def test_positions(spark):
    items, _ = fixture()
    d = prose(30, "a") + items[6][1] + prose(30, "b")
    r = dc.contaminated(spark.createDataFrame([(1, " ".join(d), 0)], DOCS), spark.createDataFrame([(6, " ".join(items[6][1]), 0)], ITEMS)).first()
    assert (r.distance, r.start_word, r.end_word) == (0, 30, 30 + len(items[6][1]))


def test_empty(spark):
    t, b = spark.createDataFrame([(1, "a b", 1)], DOCS), spark.createDataFrame([], ITEMS)
    assert dc.contaminated(t, b).count() == 0 and dc.drop_contaminated(t, b).count() == 1
    assert dc.contaminated(t.limit(0), b).count() == 0
