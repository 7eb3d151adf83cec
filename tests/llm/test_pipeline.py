import corpus_pipeline as cp
import duckdb
import pytest

from quillon.llm import decontaminate, kneser_ney, mixing, paragraphs, queries, simhash

SF = "/root/testdata/sf0.001"


def test_each_stage_does_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in cp.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            gone = {r.doc_id for r in kneser_ney.train(docs, labels).scored(docs).where("rejected").collect()}
        elif name == "near_duplicates":
            gone = {r.doc_id for r in simhash.near_duplicates(docs).collect()}
        elif name == "benchmark_leaks":
            gone = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
        else:
            gone = set()
        out = stage(spark, docs, SF)
        got = out.collect()
        if name == "mixture":
            kept = {r.doc_id for r in mixing.mix(docs, least=0.25).collect()}
            assert {r.doc_id for r in got} == kept and out.columns == first and all(r == rows[r.doc_id] for r in got)
            break
        assert out.columns == first and {r.doc_id for r in got} == set(rows) - gone
        if name == "repeated_passages":
            hit = {r.doc_id for r in paragraphs.repeats(docs, natural=True).collect()}
            assert all((r.text != rows[r.doc_id].text) == (r.doc_id in hit) and r.n_chars == len(r.text) for r in got) and hit
        else:
            assert all(r == rows[r.doc_id] for r in got)
        docs = spark.createDataFrame(got, out.schema)


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == spark.read.parquet(f"{SF}/documents.parquet").columns and out.count() > 20


ODD = "doc_id int, text string, lang string, source string, n_chars int, __id int, pid string, `a.b` string, band long"


def tables(spark, folder, rows):
    """A folder of tables, of which the documents have odd rows, repeated ones and columns of clashing names."""
    spark.createDataFrame(rows, ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, None), (1, None, None)], "doc_id int, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "what is the one thing that nobody has ever seen here"), (2, None), (None, "x"), (3, "")], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")


def odd_rows():
    import random

    r = random.Random(3)
    words = [f"word{i}" for i in range(2000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(60), "en" if i % 3 else None, f"s{i % 2}" if i % 7 else None, 1, 5, "p", "q", 9) for i in range(40)]
    rows += [(100, None, "en", "s0", 0, 5, "p", "q", 9), (101, "", "en", "s0", 0, 5, "p", "q", 9), (None, text(50), "en", "s1", 1, 5, "p", "q", 9), (102, text(40_000), "en", "s1", 1, 5, "p", "q", 9)]
    rows += [rows[4], (5, text(70), "en", "s1", 1, 5, "p", "q", 9), (103, rows[6][1], "xx", "s1", 1, 5, "p", "q", 9), (104, text(20) + " what is the one thing that nobody has ever seen here", "en", "s0", 1, 5, "p", "q", 9)]
    return rows


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_odd_tables(spark, tmp_path, name):
    folder = str(tmp_path / "quillon" / "sf")
    tables(spark, folder, odd_rows())
    stage = dict(cp.STAGES)[name]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    out = stage(spark, docs, folder)
    after = [tuple(r) for r in out.collect()]
    assert out.columns == docs.columns and after
    keys = lambda rows: sorted(str(r[0]) for r in rows)
    if name == "repeated_passages":
        assert keys(after) == keys(before)
    else:
        assert all(r in before for r in after)
    if name in ("quality", "repeated_passages", "benchmark_leaks"):
        assert {str(r[0]) for r in after} >= {"None", "100", "101"}
    if name == "benchmark_leaks":
        assert keys(after) == [k for k in keys(before) if k != "104"]
    if name == "near_duplicates":
        gone = set(keys(before)) - set(keys(after))
        assert gone == {"103"}
    if name == "mixture":
        assert "None" not in keys(after)
    empty = docs.limit(0)
    assert stage(spark, empty, folder).count() == 0


def test_run_leaves_its_input_alone(spark, tmp_path):
    """The tables lie in a folder of the name that kept tables have."""
    folder = tmp_path / "quillon" / "sf"
    tables(spark, str(folder), odd_rows())
    out = cp.run(spark, str(folder))
    ids = {r.doc_id for r in out.collect()}
    assert ids and not ids & {103, 104, None}
    assert {x.name for x in folder.iterdir()} == {"documents.parquet", "labels.parquet", "benchmark.parquet"}
    assert spark.read.parquet(str(folder / "documents.parquet")).count() == len(odd_rows())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    got = sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    r = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = sorted(map(str, (tuple(row[names.index(c)] for c in sorted(names)) for row in r.fetchall())))
    assert got == want and got


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]


def test_stock_phrases_cost_no_comparison_a_pair(spark, monkeypatch):
    """Stage 3: paragraphs of unlike texts that begin with one stock phrase share bands; few of their pairs are compared."""
    import random

    asked, real = [], paragraphs.similar

    def similar(pairs, grams, threshold):
        asked.append(pairs.count())
        return real(pairs, grams, threshold)

    monkeypatch.setattr(paragraphs, "similar", similar)
    r = random.Random(3)
    rows = [(i, "the following notice applies to all " + " ".join(f"w{r.randrange(10**6)}" for _ in range(4))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "CAST(length(text) AS INT) AS n_chars")
    left = {x.doc_id: x.text for x in cp.repeated_passages(spark, docs, "").collect()}
    assert left == dict(rows) and sum(asked) < 2000


def test_executors_give_heap_back(spark):
    """Tasks on a cluster make their JVM collect; with a local master nothing is done."""
    from types import SimpleNamespace

    from quillon.llm import storage

    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="local-cluster[3,2,1000]", defaultParallelism=4), range=spark.range)
    before = beans()
    storage.give_back(cluster)
    assert beans() >= before + 4


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_each_stage_begins_with_room(spark, monkeypatch, name):
    from quillon.llm import storage

    calls = []
    monkeypatch.setattr(storage, "give_back", calls.append)
    dict(cp.STAGES)[name](spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF)
    assert calls
