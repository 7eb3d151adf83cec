import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import versions
from quillon.functions.similarity import edit_distance, lz_set, path_edits, ratio_at_least
from quillon.operators import diff, files
from quillon.operators import packages as pk
from quillon.plans import scan as plan
from quillon.rules import glob_regex, rule_of
from quillon.sinks import formats
from quillon.sources import readers
from quillon.streaming import worker


def zipped(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in members.items():
            z.writestr(k.replace("__", "/"), v)
    return b.getvalue()


def tarred(members, mode="w:gz"):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode=mode) as t:
        for k, v in members.items():
            m = tarfile.TarInfo(k)
            m.size = len(v)
            t.addfile(m, io.BytesIO(v))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    return b.getvalue()


def test_unpack_nested(spark):
    inner = zipped(**{"a.py": b"import os\nos.system('x')\n"})
    outer = tarred({"in/deep.zip": inner, "../evil": b"x", "b.txt": b"flask\n"})
    t = spark.createDataFrame([("f", "p.tgz", bytearray(outer)), ("n", "n.txt", None), ("e", "e.txt", bytearray(b""))], "file_id string, path string, content binary")
    every, problems = files.unpack(t)
    assert {r.path for r in every.collect()} == {"p.tgz", "n.txt", "e.txt", "p.tgz$in/deep.zip", "p.tgz$b.txt", "p.tgz$in/deep.zip$a.py"}
    assert {(r["class"], r.score) for r in problems.collect()} == {("SuspiciousArchiveEntry", 50), ("ArchiveAnomaly", 100)}


def test_depth_limit_and_broken(spark):
    data = b"x"
    for i in range(8):
        data = zipped(**{f"l{i}.zip": data})
    t = spark.createDataFrame([("f", "p.zip", bytearray(data)), ("b", "b.zip", bytearray(b"PK\x03\x04broken"))], "file_id string, path string, content binary")
    every, problems = files.unpack(t)
    assert every.agg(F.max("depth")).first()[0] == files.MAX_DEPTH
    assert {r["class"] for r in problems.collect()} == {"DataProcessing", "ArchiveAnomaly"}
    assert list(files.members(zipped(a=b"12345"), most=3)) == [("a", None, "ArchiveAnomaly", 100)]


def test_file_checks():
    assert files.xml_problems(b"<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>") == [("dtd", 20), ("entities", 100)]
    assert files.xml_problems(b"<a/>") == []
    assert ("external", 100) in files.xml_problems(b"<!DOCTYPE a SYSTEM 'http://x/y.dtd'><a/>")
    assert files.pypirc_leaks("[pypi]\nusername=me\npassword=secret\n[test]\nusername=\npassword=\n") == ["pypi"]
    found = files.requirement_findings("# c\nflask\nrequests==1.0\nfoo @ https://x/y\n-e .\n???\nbar>=1 # z\n", {"requests": "2.0"})
    assert [(n, k) for n, k, *_ in found] == [(1, "UnpinnedPackage"), (2, "OutdatedPackage"), (3, "InvalidRequirement"), (5, "InvalidRequirement"), (6, "UnpinnedPackage")]
    assert files.locked('[[package]]\nname="a"\nversion="1"\n') == [("a", "1")] and files.locked("[") == []
    r = files.ByteRule("r", ["hex:41 ?? 43", "re:x\\d+", "nocase:HeLLo"], 1, per_pattern=2)
    assert r.match(b"AbC hello") == 5 and r.match(b"nothing") is None


@pytest.mark.parametrize("a,b,d", [("ab", "ba", 1), ("abc", "abc", 0), ("requests", "request", 1), ("a", "abcdef", None), ("", "ab", 2), ("kitten", "sitting", 3)])
def test_edit_distance(a, b, d):
    assert edit_distance(a, b) == d


def test_similarities():
    assert ratio_at_least("abcdefghij", "abcdefghix") == pytest.approx(0.9) and ratio_at_least("abc", "xyz") is None
    assert path_edits("a/b/c", "a/x/c") == 1 and path_edits("a", "a") == 0 and path_edits("a/b", "a/b/c/d") == 2
    assert len(lz_set(b"aaaa")) == 2 and lz_set(b"") == set()


@pytest.mark.parametrize("low,high", [("1.0", "1.0.1"), ("1.0a1", "1.0"), ("1.0.dev1", "1.0a1"), ("1.0", "1.0.post1"), ("1.9", "1.10"), ("2.0", "1!0.1"), ("1.0a1", "1.0b1"), ("1.0rc1", "1.0")])
def test_version_order(low, high):
    assert versions.version_key(low) < versions.version_key(high)


def test_specifiers():
    assert versions.version_key("x!") is None and versions.version_key("1.0") == versions.version_key("1.0.0")
    assert versions.satisfies("1.4.2", "~=1.4") and not versions.satisfies("2.0", "~=1.4") and versions.satisfies("1.4.2", "==1.4.*") and not versions.satisfies("1.5", ">=1,!=1.5")
    assert versions.marker_allows("extra == 'x'", {"x"}) and not versions.marker_allows("extra == 'x'", set()) and versions.marker_allows("python_version > '3'", set())
    assert versions.parse_requirement("a.b[x,y] >=1,<2 ; extra == 'z'") == {"name": "a.b", "extras": ["x", "y"], "specifier": ">=1,<2", "url": None, "marker": "extra == 'z'"}


def test_rules(spark):
    import re

    for p, yes, no in (("*.py", "a.py", "a.pyc"), ("a?c", "abc", "ac"), ("[!a]b", "cb", "ab"), ("[a-c]x", "bx", "dx"), ("a.b", "a.b", "axb")):
        python = glob_regex(p).replace("\\z", "\\Z")
        assert re.match(python, yes) and not re.match(python, no)
        got = spark.range(1).select(F.lit(yes).rlike(glob_regex(p)), F.lit(no).rlike(glob_regex(p))).first()
        assert tuple(got) == (True, False)
    assert rule_of("abc").kind == "exact" and rule_of({"type": "regex", "pattern": "x", "flags": "I"}).ignore_case
    with pytest.raises(ValueError):
        rule_of({"type": "other", "pattern": "x"})


def test_scan_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("import os\nos.system(input())\n")
    (tmp_path / "in" / ".hidden").write_text("x")
    (tmp_path / "in" / "requirements.txt").write_text("flask\n")
    (tmp_path / "in" / "z.zip").write_bytes(zipped(**{"b.py": b"eval(input())\n"}))
    found = plan.scan(spark, str(tmp_path / "in")).cache()
    classes = {r["class"] for r in found.collect()}
    assert {"TaintAnomaly", "FunctionCall", "UnpinnedPackage", "SuspiciousFile"} <= classes
    assert found.where("class = 'TaintAnomaly'").count() == 2
    for f in ("json", "gitlab", "sarif"):
        formats.write(found, f"{f}://{tmp_path}/{f}")
        assert json.loads(spark.read.text(str(tmp_path / f)).first()[0])
    n = formats.to_sqlite(found, str(tmp_path / "db"))
    assert n == found.select("signature").distinct().count() and formats.to_sqlite(found, str(tmp_path / "db")) == 0
    formats.write(found, f"jsonl://{tmp_path}/jsonl", min_score=10**6)
    assert spark.read.text(str(tmp_path / "jsonl")).count() == 0
    assert any("TaintAnomaly" in x for x in formats.text_report(found))
    assert "atob" in formats.html_report("{}")
    with pytest.raises(ValueError):
        formats.parse_output("json://x?min_score=1", min_score=2)
    assert formats.parse_output("json://x/y?all=yes") == {"format": "json", "path": "x/y", "all": True}


def test_sources(spark, tmp_path):
    (tmp_path / "s").write_text('{"package_name":"A_b","downloads":"30"}\n{"package_name":"c","downloads":5}\n{"package_name":"d","downloads":50}\n')
    stats = readers.download_stats(spark, str(tmp_path / "s"))
    assert [r.name for r in pk.popular(stats, 10).collect()] == ["a-b"]
    (tmp_path / "l").write_text("# x\n\nflask\npypi://a\n")
    assert {r.uri for r in readers.uri_list(spark, str(tmp_path / "l")).collect()} == {"mirror://flask", "pypi://a"}
    (tmp_path / "g").write_text("got packages/aa/Flask_X-1.0-py3-none-any.whl ok\n")
    assert readers.mirror_log(spark, str(tmp_path / "g")).first().uri == "mirror://flask-x?release=1.0&filename=Flask_X-1.0-py3-none-any.whl"
    (tmp_path / "d").write_text('{"root": ["leaf", "stem"], "stem": ["bud", "root"], "other": ["root"]}')
    edges = readers.reverse_dependencies(spark, str(tmp_path / "d"))
    got = {(r.name, r.depth) for r in pk.dependents(edges, spark.createDataFrame([("root",)], "name string")).collect()}
    assert got == {("root", 0), ("leaf", 1), ("stem", 1), ("bud", 2)}
    assert formats.gexf(edges).count("<edge ") == 5
    root = tmp_path / "m"
    (root / "json").mkdir(parents=True)
    (root / "packages").mkdir()
    (root / "packages" / "w-2.0.tar.gz").write_bytes(b"x")
    release = lambda f, k: [{"filename": f, "packagetype": k}]
    (root / "json" / "w").write_text(json.dumps({"info": {"name": "w"}, "releases": {"1.0": release("w-1.0.tar.gz", "sdist"), "2.0": release("w-2.0.tar.gz", "sdist")}}))
    assert [r.path for r in readers.read(spark, f"mirror://{root}?package=w").collect()] == ["w-2.0.tar.gz"]
    with pytest.raises(ConnectionError):
        readers.read(spark, "pypi://x")
    assert readers.configuration("---\nb: 5\n", "a: 1\n") == {"b": 5}
    assert readers.setting({"a": {"b": 1}}, "a.b") == 1 and readers.setting({}, "a.b", 2) == 2


def test_renames(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here " * 5
    a = spark.createDataFrame([("x/a.py", "1", text), ("x/same.py", "2", "s"), ("x/gone.py", "3", "zzzz")], "path string, md5 string, text string")
    b = spark.createDataFrame([("x/b.py", "4", text + "!"), ("x/same.py", "2", "s"), ("x/new.py", "5", "0123456789")], "path string, md5 string, text string")
    got = {(r.operation, r.a_ref, r.b_ref) for r in diff.with_renames(diff.by_name(a, b), a, b).collect()}
    assert got == {("M", "x/a.py", "x/b.py"), ("M", "x/same.py", "x/same.py"), ("R", "x/gone.py", None), ("A", None, "x/new.py")}


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail me@example.com", "s"), (2, "mail me@example.com", "s"), (3, "none", "s")], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    q = worker.work(worker.queue(spark, str(tmp_path / "in"), "doc_id long, text string, source string"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    events = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("a", "2024-01-01 05:00:00")], "event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "ev"))
    stream = worker.windowed_counts(spark.readStream.schema("event_type string, ts timestamp").parquet(str(tmp_path / "ev")))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("SELECT n FROM counts").collect()] == [2]


def test_trust_and_licences(spark):
    t = spark.sql("SELECT 'p' AS name, 1000 AS downloads, CAST(NULL AS long) AS n_reverse, 11 AS stars, 0 AS forks, 1 AS contributors, TIMESTAMP_NTZ '2024-01-01' AS last_commit, TIMESTAMP_NTZ '2020-01-01' AS created, TIMESTAMP_NTZ '2024-02-01' AS now, 3 AS n_releases, true AS has_wheel, false AS has_sdist, 'h' AS homepage, CAST(NULL AS string) AS docs, 2 AS n_classifiers")
    r = pk.trust_score(t).first()
    assert (r.pypi_downloads, r.github_stars, r.last_commit, r.total) == (3, 2, 1, 10)


def test_scan_of_a_wheel_and_blobs(spark, tmp_path):
    import base64
    import hashlib

    digest = lambda b: base64.urlsafe_b64encode(hashlib.sha256(b).digest()).decode().rstrip("=")
    inner = b"import os\nos.system(input())\n" * 4
    good, bad = b"x = 1\n", b"y = 2\n"
    record = f"p/a.py,sha256={digest(good)},6\np/b.py,sha256={digest(good)},6\np/gone.py,sha256=x,1\np-1.dist-info/RECORD,,\n".encode()
    members = {"p/a.py": good, "p/b.py": bad, "p/more.py": b"BLOB = '" + base64.b64encode(inner) + b"'\n", "p-1.dist-info/RECORD": record, "p/id_rsa": b"k"}
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "p-1-py3-none-any.whl").write_bytes(zipped(**members))
    found = plan.scan(spark, str(folder)).collect()
    problems = {(r.message.split(": ")[0], r.message.rsplit("$", 1)[1]) for r in found if r["class"] == "PythonDistribution"}
    assert problems == {("bad_digest", "p/b.py"), ("missing", "p/gone.py"), ("unlisted", "p/more.py"), ("unlisted", "p/id_rsa")}
    assert any(r["class"] == "SensitiveFile" and r.score == 100 and r.severity == "critical" for r in found)
    assert any(r["class"] == "FileStats" and r.file_id.endswith("$blob") for r in found)
    shown = {json.loads(r.extra)["id"] for r in found if r["class"] == "Behavior"}
    assert "file_access" not in shown
    for f in ("html", "sbom"):
        formats.write(spark.createDataFrame(found, plan.scan(spark, str(folder)).schema), f"{f}://{tmp_path}/{f}")


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("import mylib\nmylib.danger(1, mode='x')\nT = 'needle here'\n")
    (tmp_path / "in" / "odd.name").write_text("z")
    own = {"patterns": [{"id": "danger", "pattern": ["mylib.danger(..., mode='x')"], "detection": {"score": 77, "message": "own"}, "tags": ["own:tag"]}], "strings": [{"id": "n", "type": "regex", "pattern": "needle", "score": 7}], "files": [{"type": "exact", "pattern": "odd.name", "target": "filename", "tags": ["own:file"]}]}
    (tmp_path / "rules.json").write_text(json.dumps(own))
    found = plan.scan(spark, str(tmp_path / "in"), settings=plan.settings_of(str(tmp_path / "rules.json"))).collect()
    assert any(r.score == 77 and "own:tag" in r.tags and r.line_no == 2 for r in found)
    assert any(r.score == 7 and r["class"] == "StringMatch" for r in found) and any("own:file" in r.tags for r in found)
    without = plan.scan(spark, str(tmp_path / "in")).collect()
    assert not any(r.score in (7, 77) for r in without)


def test_changes_of_archives(spark, tmp_path):
    for side, text in (("l", b"a = 1\nb = 2\n"), ("r", b"a = 1\nb = 3\n")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "x.zip").write_bytes(zipped(**{"m.py": text, "same.txt": b"s"}))
        (tmp_path / side / "plain.txt").write_bytes(b"p")
    got = diff.snapshots(*readers.read_pair(spark, str(tmp_path / "l"), str(tmp_path / "r")))
    rows = {r.a_ref: r for r in got.collect()}
    assert {k.rsplit("/", 1)[-1] for k in rows} == {"x.zip", "x.zip$m.py"}
    patch = next(r.patch for k, r in rows.items() if k.endswith("m.py"))
    assert "-b = 2" in patch and "+b = 3" in patch
    assert formats.changes_to_sqlite(got, str(tmp_path / "d")) == 2
    formats.write_changes(got, f"json://{tmp_path}/j")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_hooks_of_names(spark):
    scans = spark.createDataFrame([("s1", "reqests"), ("s2", "other")], "scan_id string, name string")
    found = plan.typosquatting(scans, spark.createDataFrame([("requests",), ("flask",)], "name string")).collect()
    assert [(r.scan_id, r["class"], r.score, r.informational) for r in found] == [("s1", "Typosquatting", 0, True)]


def test_renames_miss_no_pair(spark):
    import itertools
    import random

    from quillon.functions.similarity import lz_set

    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(4)]
    change = lambda t: " ".join(x if r.random() > 0.05 else "new" for x in t.split())
    left = [(f"l/{i}.py", change(base[i % 4])) for i in range(8)]
    right = [(f"r/{i}.py", change(base[i % 4])) for i in range(8)]
    a, b = (spark.createDataFrame([(p, str(hash(t)), t) for p, t in side], "path string, md5 string, text string") for side in (left, right))
    got = {(x.a_ref, x.b_ref) for x in diff.with_renames(diff.by_name(a, b), a, b, 0.3).where("operation = 'M'").collect()}
    share = {(p, q): len(lz_set(t.encode()) & lz_set(u.encode())) / len(lz_set(t.encode()) | lz_set(u.encode())) for (p, t), (q, u) in itertools.product(left, right)}
    left_over = sorted(((-s, p, q) for (p, q), s in share.items() if s >= 0.3))
    want, used = set(), set()
    for _, p, q in left_over:
        if p not in used and q not in used:
            want.add((p, q))
            used |= {p, q}
    assert want and got == want


def test_candidates_of_renames_are_few(spark):
    """Texts of one vocabulary share many of their phrases; only pairs near the bound are compared in full, and none of those is missed."""
    import itertools
    import random

    from quillon.functions.similarity import lz_set
    from quillon.operators import overlap

    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(80)]
    write = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [write(n) for n in (1, 2, 5, 20, 60, 200, 700) for _ in range(12)]
    change = lambda t, share: " ".join(x if r.random() > share else r.choice(words) for x in t.split())
    sides = [[(f"{s}/{i}", sorted(lz_set(change(t, r.choice((0, 0.02, 0.1, 0.3))).encode()))) for i, t in enumerate(base + [write(len(t.split())) for t in base])] + [(f"{s}/empty", [])] for s in "lr"]
    a, b = (spark.createDataFrame(side, "path string, hashes array<long>") for side in sides)
    share = {(p, q): len({*x} & {*y}) / len({*x} | {*y}) for (p, x), (q, y) in itertools.product(*sides) if x or y}
    for least in (0.3, 0.6, 0.9, 1.0):
        met = [tuple(x) for x in overlap.candidates(a, b, least).collect()]
        assert len(met) == len(set(met)) and set(met) >= {k for k, v in share.items() if v >= least > 0}
        assert len(met) < 1.5 * sum(v >= least for v in share.values()) + 100
    assert sum(v >= 0.6 for v in share.values()) > 50


def test_blocks_of_candidates(spark, monkeypatch):
    """Classes cut into many blocks on both sides give each pair once."""
    from quillon.operators import overlap

    monkeypatch.setattr(overlap, "BLOCK", 60)
    monkeypatch.setattr(overlap, "TILE", 16)
    sets = [(f"{i:03}", [i * 1_000_003 + k for k in range(20)]) for i in range(40)]
    a, b = (spark.createDataFrame(sets, "path string, hashes array<long>").repartition(n) for n in (3, 2))
    assert sorted(tuple(x) for x in overlap.candidates(a, b, 0.6).collect()) == [(p, p) for p, _ in sets]


def test_renames_of_equal_shares_take_no_rounds(spark):
    n = 70
    pairs = [(f"a{i:02}", f"b{j:02}", 0.75) for i in range(n) for j in range(n)] + [("x", "b00", 0.8), ("x", "y", 0.7), ("z", "y", 0.65)]
    group = "renames-of-equal-shares"
    spark.sparkContext.setJobGroup(group, group)
    got = {(r.a, r.b) for r in diff.best_first(spark.createDataFrame(pairs, "a string, b string, similarity double")).collect()}
    assert got == {("x", "b00"), ("z", "y")} | {(f"a{i:02}", f"b{i + 1:02}") for i in range(n - 1)}
    # A round a file would be as many jobs and more.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < n / 2


def test_order_keys_are_those_of_the_parser(spark):
    """Plain versions are read without Python, with the same numbers; the rest, and what is no version, as before."""
    from quillon.functions import versions

    odd = ["1", "1.0", "0.0", "01.002", "1.2.3.4.5.6.7.8.9", "1!2.0", "1.0rc1", "1.0.post2", "1.0.dev3", "v2", " 1.0 ", "1.0\n", "1.", ".1", "1..2", "", "x", "1.0+local", "٣.1", "999999999999999999.1", "0" * 25 + "7", "2-1", None]
    t = spark.createDataFrame([(x,) for x in odd], "version string")
    for r in t.select("version", versions.order_key(F.col("version")).alias("key")).collect():
        assert r.key == versions.version_key(r.version), r.version


def test_paired_versions_read_each_side_once(spark):
    """One aggregation of both sides, with no join and no window; equal versions go to the first by name, names of one side are left out."""
    left = [("p", "1.0"), ("p", "2.0"), ("p", "2.0"), ("q", "1.0"), ("q", "1.0rc1"), ("r", "3"), ("s", "1"), ("t", "x"), ("u", "1.0"), ("u", "1"), (None, "1"), ("v", "10"), ("v", "9"), ("w", "1.12345"), ("w", "1.9999"), ("w", "2.0a1"), ("w", "0.1")]
    right = [("p", "1.0"), ("p", "3.0"), ("q", "1.0rc1"), ("q", "1.0.dev1"), ("r", "4"), ("r", "3"), ("t", "1"), ("u", "1.0.0"), ("u", "0.9"), (None, "1"), ("v", "8"), ("v", "10"), ("w", "0.1"), ("w", "0.0.0.0.9")]
    a, b = (spark.createDataFrame(x, "name string, version string") for x in (left, right))
    both = pk.paired_versions(a, b)
    got = {r["name"]: (r.left_version, r.right_version) for r in both.collect()}
    assert got == {"p": ("2.0", "3.0"), "q": ("1.0rc1", "1.0rc1"), "r": ("3", "3"), "u": ("1", "1.0.0"), "v": ("10", "10"), "w": ("0.1", "0.1")}
    assert {r["name"]: (r.left_version, r.right_version) for r in pk.paired_versions(a, b, True).where("name = 'q'").collect()} == {"q": ("1.0", "1.0rc1")}
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
