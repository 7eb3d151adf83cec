import hashlib
import re

from quillon.llm import mixing


def brute(rows, weights=None, shares=(0.25, 0.5, 1.0), seed="mix"):
    counted = [(i, s, int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16), len(re.findall(r"[^ \t\n\r\f]+", t or ""))) for i, t, s in rows if i is not None]
    totals = {}
    for _, s, _, n in counted:
        totals[s] = totals.get(s, 0) + n
    w = {s: (1.0 if weights is None else weights.get(s, 0)) for s, n in totals.items() if n}
    w = {s: x for s, x in w.items() if x > 0}
    if not w:
        return set()
    unit = min(totals[s] / x for s, x in w.items())
    out = []
    for s in w:
        own = sorted({h for _, s2, h, _ in counted if s2 == s})
        for share in sorted(shares, reverse=True):
            budget = int(w[s] * unit * share + 1e-6)
            run, below = 0, -1
            for h in own:
                run += sum(n for _, s2, h2, n in counted if s2 == s and h2 == h)
                if run > budget:
                    break
                below = h
            out += [(i, s, n, share) for i, s2, h, n in counted if s2 == s and h <= below]
    best = {}
    for k, (i, s, n, share) in enumerate(out):
        best[(i, s, n)] = min(share, best.get((i, s, n), 9))
    return {(*k, v) for k, v in best.items()}


def rows(n):
    out = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", None][i % 3 if i % 5 else 0]) for i in range(n)]
    return out + [(None, "x y", "a"), (n, None, "a"), (n + 1, "", "b"), (n + 2, "only one", "c"), (3, "w w w", "a"), (3, "w w w", "a")]


SCHEMA = "doc_id long, text string, source string"


def got(df):
    return {tuple(r) for r in df.collect()}


def test_against_brute_force(spark):
    r = rows(300)
    t = spark.createDataFrame(r, SCHEMA)
    assert got(mixing.mix(t)) == brute(r)
    w = {"a": 3.0, "b": 1.0, "zero": 2.0, "c": 0.0}
    assert got(mixing.mix(t, w, (0.1, 0.9))) == brute(r, w, (0.1, 0.9))


def test_nested_and_full_rows(spark):
    t = spark.createDataFrame([(*x, 1, "s") for x in rows(200)], SCHEMA + ", __s int, __hash string")
    small, large = mixing.keep_mixed(t, {"a": 1, "b": 1}, 0.4), mixing.keep_mixed(t, {"a": 1, "b": 1}, 0.8)
    assert small.columns == t.columns
    a, b = {r.doc_id for r in small.collect()}, {r.doc_id for r in large.collect()}
    assert a < b


def test_empty(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(t).count() == 0 and mixing.keep_mixed(t).count() == 0
    t = spark.createDataFrame([(1, None, None), (2, "", "a")], SCHEMA)
    assert mixing.mix(t).count() == 0


def test_tiny_sources_bound_no_other(spark, tmp_path):
    """A null source and one of two words, beside two sources of 300 documents, through the registered query."""
    from quillon.llm import queries

    r = [(i, "w " * 20, "ab"[i % 2]) for i in range(600)] + [(1000, "x y z", None), (1001, "x y", None), (1002, "only one", "c")]
    spark.createDataFrame(r, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_mixing(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == {i for i, *_ in r}
    half = {s: sum(x.n_tokens for x in out if x.source == s and x.share <= 0.5) for s in "ab"}
    assert all(2900 <= n <= 3000 for n in half.values())
    # Without a floor the tiny source bounds all.
    assert sum(x.n_tokens for x in mixing.mix(spark.createDataFrame(r, SCHEMA)).collect()) <= 3 * 4
    none = spark.createDataFrame([(i, "w w", None) for i in range(50)], SCHEMA)
    assert mixing.mix(none, least=0.25).count() == 50
    assert mixing.mix(none.limit(0), least=0.25).count() == 0
