"""Packages: popularity, look-alikes, releases, trust, licences, dependencies. Parts, orders and line items stand for packages, releases and requirements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import similarity, versions
from quillon.operators import packages as pk
from quillon.registry import query


def _of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STATS = "stats AS (SELECT p_partkey AS ord, p_name || '.' || p_partkey AS name, 100000 - p_partkey * 37 + (p_partkey * 7919) % 5000 AS downloads FROM part)"


def _stats(spark, sf_dir):
    c = F.col("p_partkey")
    return _of(spark, sf_dir, "part").select(c.alias("ord"), F.concat("p_name", F.lit("."), c.cast("string")).alias("name"), (100000 - c * 37 + (c * 7919) % 5000).alias("downloads"))


@query(f"WITH {_STATS} SELECT name, downloads FROM stats WHERE ord < coalesce((SELECT min(ord) FROM stats WHERE downloads < 90000), 1000000000000)")
def popular_takewhile(spark, sf_dir):
    return pk.popular(_stats(spark, sf_dir), 90000).select("name", "downloads")


@query(f"WITH {_STATS} SELECT name, downloads FROM stats WHERE ord <= coalesce((SELECT min(ord) FROM stats WHERE p_hit), 1000000000000)".replace("SELECT min(ord) FROM stats WHERE p_hit", "SELECT min(ord) - 1 FROM stats WHERE name LIKE 'hot%' AND ord > 5"))
def stop_at_self(spark, sf_dir):
    """The names before the first that is the looked-up one."""
    t = _stats(spark, sf_dir)
    end = t.where("name LIKE 'hot%' AND ord > 5").agg(F.min("ord").alias("end"))
    return t.crossJoin(end).where(F.col("end").isNull() | (F.col("ord") < F.col("end"))).select("name", "downloads")


@query("SELECT p_name AS name, count(*) AS n, sum(l_quantity)::BIGINT AS downloads FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY p_name")
def popularity(spark, sf_dir):
    t = _of(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1995-01-01'").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return t.join(_of(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("name")).agg(F.sum("n").alias("n"), F.sum("q").cast("long").alias("downloads"))


_NAMES = """popular AS (SELECT DISTINCT p_name AS popular FROM part),
names AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name[1:k] || p_name[k + 2:] WHEN 1 THEN p_name[1:k] || 'x' || p_name[k + 1:] ELSE p_name[1:k] || 'q' || p_name[k + 2:] END AS name
  FROM (SELECT p_partkey, p_name, p_partkey % len(p_name) AS k FROM part)),
squats AS (SELECT name FROM names WHERE name NOT IN (SELECT popular FROM popular))"""


def _names(spark, sf_dir):
    k = (F.col("p_partkey") % F.length("p_name")).cast("int")
    t = _of(spark, sf_dir, "part").withColumn("k", k)
    head, rest = F.substring("p_name", F.lit(1), F.col("k")), lambda i: F.substring(F.col("p_name"), F.col("k") + i, F.length("p_name"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(head, rest(2))).when(F.col("p_partkey") % 3 == 1, F.concat(head, F.lit("x"), rest(1))).otherwise(F.concat(head, F.lit("q"), rest(2)))
    return t.select(name.alias("name")), t.select(F.col("p_name").alias("name"))


@query(f"WITH {_NAMES} SELECT name, popular, levenshtein(name, popular)::INTEGER AS distance FROM squats, popular WHERE levenshtein(name, popular) BETWEEN 1 AND 1")
def typosquat_levenshtein(spark, sf_dir):
    return pk.lookalikes(*_names(spark, sf_dir), native=True)


@query(f"WITH {_NAMES} SELECT name, popular, levenshtein(name, popular)::INTEGER AS distance FROM squats, popular WHERE levenshtein(name, popular) BETWEEN 1 AND 2")
def typosquat_wide(spark, sf_dir):
    return pk.lookalikes(*_names(spark, sf_dir), most=2, native=True)


@query()
def typosquat_names(spark, sf_dir):
    return pk.lookalikes(*_names(spark, sf_dir))


_RELEASES = """releases AS (SELECT l_partkey::VARCHAR AS name, (l_suppkey % 10) || '.' || l_linenumber AS version, l_orderkey || '-' || l_linenumber || '.f' AS filename,
  ['sdist', 'bdist_wheel', 'bdist_egg'][(l_orderkey % 3 + 1)::INT] AS packagetype, ['py3', 'source'][(l_orderkey % 2 + 1)::INT] AS python_version, md5(l_orderkey::VARCHAR) AS md5 FROM lineitem)"""


def _releases(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("l_orderkey") % n + 1).cast("int"))
    return _of(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("name"),
        F.concat_ws(".", (F.col("l_suppkey") % 10).cast("string"), F.col("l_linenumber").cast("string")).alias("version"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".f")).alias("filename"),
        pick(("sdist", "bdist_wheel", "bdist_egg"), 3).alias("packagetype"),
        pick(("py3", "source"), 2).alias("python_version"),
        F.md5(F.col("l_orderkey").cast("string")).alias("md5"),
    )


@query(f"WITH {_RELEASES} SELECT name, version, filename, packagetype FROM releases QUALIFY row_number() OVER (PARTITION BY name, version ORDER BY CASE packagetype WHEN 'sdist' THEN 0 WHEN 'bdist_wheel' THEN 1 ELSE 2 END, filename) = 1")
def release_first(spark, sf_dir):
    return pk.ordered_releases(_releases(spark, sf_dir)).where("place = 1").select("name", "version", "filename", "packagetype")


@query(f"WITH {_RELEASES} SELECT name, count(*) AS n FROM releases WHERE packagetype = 'sdist' AND md5 LIKE 'a%' GROUP BY name")
def release_filters(spark, sf_dir):
    return pk.filtered_releases(_releases(spark, sf_dir), "sdist").where("md5 LIKE 'a%'").groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {_RELEASES}, v AS (SELECT DISTINCT name, version FROM releases) SELECT name, version, place FROM (SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY split_part(version, '.', 1)::INT DESC, split_part(version, '.', 2)::INT DESC, version) AS place FROM v) WHERE place <= 2")
def latest_versions(spark, sf_dir):
    return pk.latest(_releases(spark, sf_dir).select("name", "version").distinct(), 2, plain=True).select("name", "version", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_RELEASES}, v AS (SELECT DISTINCT name, version, split_part(version, '.', 1)::INT AS a, split_part(version, '.', 2)::INT AS b FROM releases)
SELECT name, version FROM v WHERE a * 100 + b >= 300 AND a * 100 + b < 702 QUALIFY row_number() OVER (PARTITION BY name ORDER BY a DESC, b DESC) = 1""")
def latest_within(spark, sf_dir):
    return pk.latest(_releases(spark, sf_dir).select("name", "version").distinct(), 1, ">=3,<7.2").select("name", "version")


@query(f"""WITH {_RELEASES}, a AS (SELECT * FROM releases WHERE version LIKE '3.%'), b AS (SELECT * FROM releases WHERE version LIKE '4.%'),
pairs AS (SELECT a.name, a.filename AS left_file, b.filename AS right_file, a.packagetype FROM a JOIN b USING (name, packagetype, python_version))
SELECT name, left_file, right_file FROM pairs QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE packagetype WHEN 'sdist' THEN 0 WHEN 'bdist_wheel' THEN 1 ELSE 2 END, left_file, right_file) = 1""")
def release_pairing(spark, sf_dir):
    """For each package the two releases to compare: of one type and Python, source distributions first."""
    t = _releases(spark, sf_dir)
    a = t.where("version LIKE '3.%'").select("name", "packagetype", "python_version", F.col("filename").alias("left_file"))
    b = t.where("version LIKE '4.%'").select("name", "packagetype", "python_version", F.col("filename").alias("right_file"))
    rank = F.when(F.col("packagetype") == "sdist", 0).when(F.col("packagetype") == "bdist_wheel", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), "left_file", "right_file")).alias("b")
    return a.join(b, ["name", "packagetype", "python_version"]).groupBy("name").agg(best).select("name", "b.left_file", "b.right_file")


@query(f"WITH {_RELEASES}, v AS (SELECT name, list_distinct(list(version)) AS vs FROM releases GROUP BY name) SELECT a.name, b.name AS other, len(list_filter(b.vs, lambda x: NOT list_contains(a.vs, x))) = 0 AS superset FROM v a JOIN v b ON b.name::BIGINT = a.name::BIGINT + 1")
def release_superset(spark, sf_dir):
    t = _releases(spark, sf_dir).groupBy("name").agg(F.collect_set("version").alias("vs")).withColumn("k", F.col("name").cast("long"))
    o = t.select(F.col("name").alias("other"), F.col("vs").alias("theirs"), (F.col("k") - 1).alias("k"))
    return t.join(o, "k").select("name", "other", (F.size(F.array_except("theirs", "vs")) == 0).alias("superset"))


_FACTS = """facts AS (SELECT p_partkey::VARCHAR AS name, p_partkey AS k, coalesce(n, 0) AS downloads, p_size AS stars, p_partkey % 7 AS forks, p_partkey % 300 AS n_reverse, coalesce(r, 0) AS n_releases, coalesce(s, 0) AS contributors, last, first
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(DISTINCT l_orderkey) AS r, count(DISTINCT l_suppkey) AS s, max(l_shipdate) AS last, min(l_shipdate) AS first FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""
_SCALED = (("downloads", "pypi_downloads"), ("n_reverse", "reverse_dependencies"), ("stars", "github_stars"), ("forks", "forks"), ("contributors", "contributors"), ("n_releases", "releases"))


@query(f"""WITH {_FACTS}, x AS (SELECT name, {', '.join(f"CASE WHEN f.{c} > 0 THEN ceil(log10(f.{c})) ELSE 0 END::BIGINT AS {a}" for c, a in _SCALED)},
  coalesce(last + INTERVAL 93 DAY >= TIMESTAMP '1998-12-01', false)::BIGINT AS last_commit, -coalesce(first + INTERVAL 186 DAY > TIMESTAMP '1998-12-01', false)::BIGINT AS is_new,
  (k % 2 = 0)::BIGINT AS wheel, (k % 3 = 0)::BIGINT AS source_archive, (k % 5 <> 0)::BIGINT AS homepage, (k % 7 = 0)::BIGINT AS documentation, (k % 4 > 0)::BIGINT AS classifiers FROM facts f)
SELECT *, pypi_downloads + reverse_dependencies + github_stars + forks + contributors + releases + last_commit + is_new + wheel + source_archive + homepage + documentation + classifiers AS total FROM x""")
def trust_score(spark, sf_dir):
    """All thirteen indicators and their sum."""
    sold = _of(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("downloads"), F.count_distinct("l_orderkey").alias("n_releases"), F.count_distinct("l_suppkey").alias("contributors"), F.max("l_shipdate").alias("last_commit"), F.min("l_shipdate").alias("created"))
    k = F.col("p_partkey")
    t = _of(spark, sf_dir, "part").join(sold, F.col("l_partkey") == k, "left")
    t = t.select(k.cast("string").alias("name"), "downloads", (k % 300).alias("n_reverse"), F.col("p_size").alias("stars"), (k % 7).alias("forks"), "contributors", "last_commit", "created", F.lit("1998-12-01").cast("timestamp_ntz").alias("now"), "n_releases", (k % 2 == 0).alias("has_wheel"), (k % 3 == 0).alias("has_sdist"), F.when(k % 5 != 0, "h").alias("homepage"), F.when(k % 7 == 0, "d").alias("docs"), (k % 4).alias("n_classifiers"))
    return pk.trust_score(t)


@query(f"WITH {_STATS}, looked AS (SELECT s_suppkey, 'HOT_' || s_suppkey AS asked FROM supplier), named AS (SELECT *, lower(regexp_replace(split_part(name, ' ', 1), '[-_.]+', '-', 'g')) || '-' || (ord % 50) AS c FROM stats) SELECT s_suppkey, n.name, n.downloads FROM looked LEFT JOIN (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY c ORDER BY ord) = 1) n ON n.c = lower(regexp_replace(asked, '[-_.]+', '-', 'g'))")
def downloads_lookup(spark, sf_dir):
    """The downloads of the first entry, in file order, of a package's canonical name."""
    from quillon.functions.text import canonical

    t = _stats(spark, sf_dir).withColumn("c", F.concat(canonical(F.split("name", " ")[0]), F.lit("-"), (F.col("ord") % 50).cast("string")))
    first = t.groupBy("c").agg(F.min_by(F.struct("name", "downloads"), "ord").alias("f"))
    asked = _of(spark, sf_dir, "supplier").select("s_suppkey", canonical(F.concat(F.lit("HOT_"), F.col("s_suppkey").cast("string"))).alias("c"))
    return asked.join(first, "c", "left").select("s_suppkey", "f.name", "f.downloads")


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 3 = 0 THEN 'https://github.com/' || p_brand WHEN p_partkey % 3 = 1 THEN 'https://example.org/' || p_brand ELSE '' END AS h, p_brand AS b, p_partkey AS k FROM part)
SELECT name, CASE WHEN k % 5 = 0 THEN 'https://src/' || b WHEN k % 3 = 0 THEN h END AS source_url, CASE WHEN h <> '' THEN h ELSE 'https://home/' || b END AS homepage, CASE WHEN k % 2 = 0 THEN 'https://docs/' || b END AS documentation, CASE WHEN k % 4 = 0 THEN 'maintainer' ELSE b END AS author FROM p""")
def package_facts(spark, sf_dir):
    k, b = F.col("p_partkey"), F.col("p_brand")
    link = lambda head: F.concat(F.lit(head), b)
    urls = F.when(k % 5 == 0, F.create_map(F.lit("Homepage"), link("https://home/"), F.lit("Source"), link("https://src/"))).otherwise(F.create_map(F.lit("Homepage"), link("https://home/")))
    t = _of(spark, sf_dir, "part").select(k.cast("string").alias("name"), F.when(k % 3 == 0, link("https://github.com/")).when(k % 3 == 1, link("https://example.org/")).otherwise("").alias("home_page"), F.when(k % 2 == 0, link("https://docs/")).alias("docs_url"), F.when(k % 4 == 0, " ").otherwise(b).alias("author"), F.lit("maintainer").alias("maintainer"), F.lit("m@x").alias("author_email"), urls.alias("project_urls"))
    return pk.facts(t)


_LICENCES = [("License :: OSI :: ECONOMY", "MIT"), ("License :: OSI :: STANDARD", "Apache-2.0"), ("License :: OSI :: PROMO", "BSD-3-Clause")]


@query(f"""WITH ids(classifier, spdx) AS (VALUES {', '.join(map(str, _LICENCES))}), p AS (SELECT p_partkey::VARCHAR AS name, ['MIT', 'BSD 3-Clause', 'Own'][(p_partkey % 3 + 1)::INT] AS licence, 'License :: OSI :: ' || p_type AS classifier FROM part),
raw AS (SELECT name, licence AS raw FROM p UNION SELECT name, classifier FROM p)
SELECT DISTINCT name, coalesce(i.spdx, CASE WHEN replace(raw, ' ', '-') IN (SELECT spdx FROM ids) THEN replace(raw, ' ', '-') END) AS licence FROM raw LEFT JOIN ids i ON raw = i.classifier WHERE coalesce(i.spdx, CASE WHEN replace(raw, ' ', '-') IN (SELECT spdx FROM ids) THEN replace(raw, ' ', '-') END) IS NOT NULL""")
def licence_lookup(spark, sf_dir):
    table = spark.createDataFrame(_LICENCES, "classifier string, spdx string")
    own = F.element_at(F.array(F.lit("MIT"), F.lit("BSD 3-Clause"), F.lit("Own")), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = _of(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), own.alias("license"), F.array(F.concat(F.lit("License :: OSI :: "), "p_type"), F.lit("Topic :: X")).alias("classifiers"))
    return pk.licence_ids(p, table)


_EDGES = "edges AS (SELECT DISTINCT l_partkey AS name, l_suppkey * 3 + l_linenumber AS dependent FROM lineitem)"


@query(f"""WITH RECURSIVE {_EDGES}, reach(name, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT dependent, depth + 1 FROM reach JOIN edges USING (name) WHERE depth < 40)
SELECT name, min(depth)::INTEGER AS depth FROM reach GROUP BY name""")
def reverse_dependencies(spark, sf_dir):
    """What depends on package 7, over the edges that all line items give."""
    e = _of(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), (F.col("l_suppkey") * 3 + F.col("l_linenumber")).alias("dependent"))
    return pk.dependents(e, spark.range(7, 8).select(F.col("id").alias("name")))


@query("""WITH lines AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS line, unnest(range(len(string_split(text, '. ')))) AS line_no FROM conversations),
t AS (SELECT conv_id, turn, line_no, lower(split_part(trim(line), ' ', 1)) AS name, len(line) % 4 AS k FROM lines),
r AS (SELECT *, regexp_matches(name, '^[a-z0-9]([a-z0-9_.-]*[a-z0-9])?$') AS good FROM t WHERE name <> '' AND NOT regexp_matches(name, '[^ -~]|#|^-|[]()<>=!~;@,[]'))
SELECT conv_id, turn, line_no::INTEGER AS line_no, CASE WHEN NOT good THEN 'InvalidRequirement' WHEN k = 0 THEN 'OutdatedPackage' WHEN k = 3 THEN 'InvalidRequirement' ELSE 'UnpinnedPackage' END AS class,
  CASE WHEN NOT good THEN 0 WHEN k = 0 THEN 5 WHEN k = 3 THEN 20 ELSE 10 END AS score FROM r""")
def requirement_pins(spark, sf_dir):
    """Sentences' first words as lines of a requirements file, pinned, bounded, free or from a URL: what the file check finds. Lines count from 0."""
    from quillon.operators import files

    t = _of(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\\. ")).alias("line_no", "line"))
    name = F.lower(F.split(F.trim("line"), " ")[0])
    t = t.select("conv_id", "turn", "line_no", name.alias("name"), (F.length("line") % 4).alias("k")).where((F.col("name") != "") & ~F.col("name").rlike(r"[^ -~]|#|^-|[\]()<>=!~;@,\[]"))
    end = F.when(F.col("k") == 0, "==0.1").when(F.col("k") == 1, ">=1.0").when(F.col("k") == 3, " @ https://x/y.zip").otherwise("")
    # A file a turn; what isn't a requirement there stands on its line as a comment.
    lines = t.groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("line_no", F.concat("name", end).alias("l")))).alias("m"), F.max("line_no").alias("last"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("#"))), "\n")
    file_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    f = lines.select(file_id.alias("file_id"), F.lit("requirements.txt").alias("path"), F.encode(body, "UTF-8").alias("content"))
    found = files.findings(f, latest=_Newest())
    parts = F.split("file_id", ":")
    return found.select(parts[0].cast("long").alias("conv_id"), parts[1].cast(dict(t.dtypes)["turn"]).alias("turn"), "line_no", "class", "score")


class _Newest(dict):
    """Every package's latest version is 1.0."""

    def __bool__(self) -> bool:
        return True

    def get(self, name: str, default=None) -> str:
        return "1.0"


_REQUIRES = """lib AS (SELECT DISTINCT (l_partkey % 97)::VARCHAR AS name, l_linenumber || '.' || (l_suppkey % 5) AS version, l_linenumber * 10 + l_suppkey % 5 AS k FROM lineitem),
needs AS (SELECT DISTINCT (l_partkey % 97)::VARCHAR AS name, l_linenumber || '.' || (l_suppkey % 5) AS version, (l_suppkey % 89)::VARCHAR AS needs, '>=1,<' || (3 + l_suppkey % 3) AS specifier, (3 + l_suppkey % 3) AS most, CASE WHEN l_quantity > 25 THEN 'extra == "x"' END AS marker FROM lineitem)"""


@query(f"""WITH RECURSIVE {_REQUIRES}, best AS (SELECT m AS most, name, arg_max(version, k) AS version FROM lib, (SELECT unnest([3, 4, 5, 99]) AS m) WHERE k < m * 10 GROUP BY m, name),
edges AS (SELECT b.most AS by_, b.name, n.needs, min(n.most) AS most FROM best b JOIN needs n ON n.name = b.name AND n.version = b.version WHERE marker IS NULL GROUP BY ALL),
walk(depth, names, front) AS (
  SELECT 0, ['7'], [{{'name': '7', 'most': 99}}]
  UNION ALL
  SELECT depth + 1, list_concat(names, list_transform(f, lambda x: x.name)), f FROM (
    SELECT depth, names, (SELECT list({{'name': needs, 'most': m}} ORDER BY needs) FROM (SELECT e.needs, min(e.most) AS m FROM (SELECT unnest(front) AS x) JOIN edges e ON e.name = x.name AND e.by_ = x.most WHERE NOT list_contains(names, e.needs) GROUP BY e.needs)) AS f FROM walk) WHERE f IS NOT NULL),
found AS (SELECT depth, unnest(front) AS x FROM walk)
SELECT x.name AS name, b.version, depth::INTEGER AS depth FROM found LEFT JOIN best b ON b.name = x.name AND b.most = x.most""")
def dependency_closure(spark, sf_dir):
    """What package 7 needs, breadth first, each in the latest version that the first asks for allow."""
    l = _of(spark, sf_dir, "lineitem")  # noqa: E741
    name, version = (F.col("l_partkey") % 97).cast("string"), F.concat(F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_suppkey") % 5).cast("string"))
    lib = l.select(name.alias("name"), version.alias("version")).distinct()
    most = (3 + F.col("l_suppkey") % 3).cast("string")
    needs = l.select(name.alias("name"), version.alias("version"), (F.col("l_suppkey") % 89).cast("string").alias("needs"), F.concat(F.lit(">=1,<"), most).alias("specifier"), F.when(F.col("l_quantity") > 25, 'extra == "x"').alias("marker")).distinct()
    return pk.dependencies(needs, lib, spark.createDataFrame([("7", None)], "name string, specifier string"))


@query(f"""WITH {_RELEASES}, v AS (SELECT DISTINCT name, version, split_part(version, '.', 1)::INT * 100 + split_part(version, '.', 2)::INT AS k FROM releases),
l AS (SELECT * FROM v WHERE k % 3 <> 0), r AS (SELECT * FROM v WHERE k % 4 <> 0), a AS (SELECT name, arg_max(version, k) AS a FROM l GROUP BY name), b AS (SELECT name, arg_max(version, k) AS b FROM r GROUP BY name),
both_ AS (SELECT name, a, b, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.name = a.name AND l.version = b) THEN b WHEN EXISTS (SELECT 1 FROM r WHERE r.name = a.name AND r.version = a) THEN a END AS common FROM a JOIN b USING (name))
SELECT name, coalesce(common, a) AS left_version, coalesce(common, b) AS right_version FROM both_""")
def version_pairing(spark, sf_dir):
    """The versions of two mirrors' packages to compare: a common one, if one's latest is in the other, else the latest of each."""
    t = _releases(spark, sf_dir).select("name", "version")
    p = F.split("version", "[.]")
    k = p[0].cast("int") * 100 + p[1].cast("int")
    return pk.paired_versions(t.where(k % 3 != 0), t.where(k % 4 != 0))


@query()
def metadata_similarity(spark, sf_dir):
    """Descriptions of neighbouring packages: their matching share where it is 0.8 or more."""
    t = _of(spark, sf_dir, "benchmark").select("item_id", "text")
    o = t.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    both = t.join(o, "item_id")
    return both.select("item_id", similarity.text_ratio("text", "other").alias("ratio"), similarity.text_ratio("text", F.concat("text", F.lit("!"))).alias("own"))


@query()
def version_order(spark, sf_dir):
    """Version strings of all kinds with the place of each among those of its package."""
    ends = F.array(*map(F.lit, ("", "a1", "rc2", ".post1", ".dev3", "+local", "-x!")))
    t = _of(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("name"), F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit("."), (F.col("o_orderkey") % 13).cast("string"), F.element_at(ends, (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("version")).distinct()
    return t.withColumn("key", versions.sort_key("version")).where("key IS NOT NULL").withColumn("place", F.rank().over(Window.partitionBy("name").orderBy(F.col("key").desc()))).drop("key")
