"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import similarity, text
from quillon.registry import query


def _of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def fn_checksums(spark, sf_dir):
    return _of(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("""WITH c AS (SELECT c_custkey, c_name, list_transform(range(1, len(c_name) + 1), lambda i: ord(c_name[i])) AS x FROM customer),
s AS (SELECT c_custkey, (1 + list_sum(x)) % 65521 AS a, (len(x) + list_sum(list_transform(range(1, len(x) + 1), lambda i: (len(x) - i + 1) * x[i]))) % 65521 AS b FROM c)
SELECT c_custkey, lower(to_hex((b * 65536 + a)::BIGINT)) AS adler FROM s""")
def fn_adler32(spark, sf_dir):
    return _of(spark, sf_dir, "customer").select("c_custkey", text.adler32(F.to_binary("c_name", F.lit("utf-8"))).alias("adler"))


@query("""WITH chars AS (SELECT doc_id, len(text) AS n, unnest(string_split(text, '')) AS c FROM documents WHERE len(text) >= 5),
counted AS (SELECT doc_id, n, c, count(*)::DOUBLE AS k FROM chars WHERE ord(c) < 255 GROUP BY ALL),
e AS (SELECT doc_id, sum(-(k / n) * log2(k / n)) AS h FROM counted GROUP BY doc_id)
SELECT doc_id, round(h, 4) AS entropy, h >= 4.2 AS high FROM e""")
def fn_entropy(spark, sf_dir):
    t = _of(spark, sf_dir, "documents").where(F.length("text") >= 5).select("doc_id", text.entropy(F.col("text")).alias("h"))
    return t.select("doc_id", F.round("h", 4).alias("entropy"), (F.col("h") >= 4.2).alias("high"))


_B64 = "'^(?:[A-Za-z0-9+/]{4}){12,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$'"


@query(f"""WITH t AS (SELECT doc_id, text, to_base64(encode(text)) AS blob FROM documents)
SELECT doc_id, regexp_matches(blob, {_B64}) AND regexp_matches(blob, '[A-Za-z0-9]$') AS is_blob, CASE WHEN regexp_matches(blob, {_B64}) AND regexp_matches(blob, '[A-Za-z0-9]$') THEN decode(from_base64(blob)) END AS decoded FROM t""")
def fn_base64(spark, sf_dir):
    """Whole texts as base64: which count as blobs, as they are 48 signs or more and end in no padding, and what they decode to."""
    t = _of(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "utf-8")), "\\s", "").alias("blob"))
    return t.select("doc_id", text.base64_blob(F.col("blob")).alias("decoded")).withColumn("is_blob", F.col("decoded").isNotNull())


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^\\x00-\\x7F]'))), '') AS characters FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]')")
def fn_non_ascii(spark, sf_dir):
    return _of(spark, sf_dir, "documents").where(F.col("text").rlike("[^\\x00-\\x7F]")).select("doc_id", text.non_ascii(F.col("text")).alias("characters"))


_STATEMENTS = ["SELECT a FROM b", "select\tx from", "SELECTION FROM x", "DELETE FROM t", "delete from x where 1", "INSERT INTO t VALUES (1)", "INSERT  INTO t (a) VALUES (1)", "insert into t", "UPDATE t SET a = 1", "UPDATE t", " SELECT a FROM b", "SELECT a\nFROM b"]


@query(f"""SELECT n_nationkey, s AS statement, regexp_matches(s, '^(SELECT[ \\t\\n]+.*FROM|DELETE[ \\t\\n].*FROM|INSERT[ \\t\\n]+INTO[ \\t\\n].*VALUES[ \\t\\n]|UPDATE[ \\t\\n].*SET[ \\t\\n]).*', 'i') AS is_sql
FROM nation, (SELECT unnest([{', '.join("'" + s.replace("'", "''") + "'" for s in _STATEMENTS)}]) AS s)""")
def fn_sql_statement(spark, sf_dir):
    t = _of(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _STATEMENTS))).alias("statement"))
    return t.select("n_nationkey", "statement", text.is_sql(F.col("statement")).alias("is_sql"))


@query("""WITH n AS (SELECT p_partkey, p_name || '__' || p_brand || '.' || p_type AS name, p_size::VARCHAR AS v FROM part)
SELECT p_partkey, lower(regexp_replace(name, '[-_.]+', '-', 'g')) AS canonical, 'pkg:pypi/' || lower(regexp_replace(name, '[-_.]+', '-', 'g')) || '@' || v AS purl,
  lower(regexp_replace(name, '[-_.]+', '-', 'g')) LIKE 'hot%' AS hot FROM n""")
def fn_package_names(spark, sf_dir):
    t = _of(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("__"), "p_brand", F.lit("."), "p_type").alias("name"), F.col("p_size").cast("string").alias("v"))
    return t.select("p_partkey", text.canonical(F.col("name")).alias("canonical"), text.purl(F.col("name"), F.col("v")).alias("purl"), text.canonical(F.col("name")).startswith("hot").alias("hot"))


@query("SELECT o_orderkey, CASE WHEN x > 0 THEN ceil(log10(x)) ELSE 0 END::BIGINT AS scale FROM (SELECT o_orderkey, floor(o_totalprice) - 100000 AS x FROM orders)")
def fn_log_scale(spark, sf_dir):
    return _of(spark, sf_dir, "orders").select("o_orderkey", text.log_scale(F.floor("o_totalprice") - 100000).alias("scale"))


@query("""WITH t AS (SELECT p_partkey, p_size || ['', 'k', 'Mb', 'G', 'tb', 'x', ' k'][p_partkey % 7 + 1] AS size FROM part)
SELECT p_partkey, size, CASE WHEN regexp_matches(lower(trim(size)), '^[0-9]+[kmgtp]?b?$') THEN
  regexp_extract(size, '^[0-9]+')::BIGINT * pow(1024, strpos('kmgtp', regexp_extract(lower(trim(size)), '^[0-9]+([kmgtp]?)b?$', 1)) * (regexp_extract(lower(trim(size)), '^[0-9]+([kmgtp]?)b?$', 1) <> '')::INT)::BIGINT END AS bytes FROM t""")
def fn_sizes(spark, sf_dir):
    units = F.array(*map(F.lit, ("", "k", "Mb", "G", "tb", "x", " k")))
    t = _of(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.element_at(units, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("size"))
    return t.select("p_partkey", "size", text.size_of(F.col("size")).alias("bytes"))


@query("""SELECT page_id, regexp_replace(url, '^([A-Za-z0-9_]+://)[^/?#]+', '\\1***') AS clean, (starts_with(path, '/') OR list_contains(string_split(path, '/'), '..')) AS unsafe,
  lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS extension
FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '/etc/a.TXT' WHEN 1 THEN 'a/../b.tar' WHEN 2 THEN 'a..b/c' ELSE regexp_replace(url, '^https?://', '') END AS path FROM pages)""")
def fn_paths(spark, sf_dir):
    path = F.when(F.col("page_id") % 4 == 0, "/etc/a.TXT").when(F.col("page_id") % 4 == 1, "a/../b.tar").when(F.col("page_id") % 4 == 2, "a..b/c").otherwise(F.regexp_replace("url", "^https?://", ""))
    t = _of(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"))
    return t.select("page_id", text.sanitized_uri(F.col("url")).alias("clean"), text.unsafe_member(F.col("path")).alias("unsafe"), text.extension(F.col("path")).alias("extension"))


@query("""WITH t AS (SELECT p_partkey, replace(p_name, ' ', '_') || '-' || p_size || '.0' || ['-py3-none-any.whl', '.tar.gz', '-py3.8.egg', '.zip', '.exe'][p_partkey % 5 + 1] AS f FROM part)
SELECT p_partkey, CASE WHEN f LIKE '%.whl' THEN 'wheel' WHEN f LIKE '%.egg' THEN 'egg' WHEN f LIKE '%.tar.gz' OR f LIKE '%.zip' THEN 'sdist' END AS kind,
  CASE WHEN f NOT LIKE '%.exe' THEN split_part(f, '-', 1) END AS name, CASE WHEN f NOT LIKE '%.exe' THEN regexp_extract(f, '-([0-9]+\\.0)', 1) END AS version FROM t""")
def fn_filenames(spark, sf_dir):
    ends = F.array(*map(F.lit, ("-py3-none-any.whl", ".tar.gz", "-py3.8.egg", ".zip", ".exe")))
    f = F.concat(F.translate("p_name", " ", "_"), F.lit("-"), F.col("p_size").cast("string"), F.lit(".0"), F.element_at(ends, (F.col("p_partkey") % 5 + 1).cast("int")))
    return _of(spark, sf_dir, "part").select("p_partkey", text.wheel_parts(f).alias("w")).select("p_partkey", "w.*")


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS words FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.words AS x, b.words AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM p""")
def fn_jaccard(spark, sf_dir):
    t = _of(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("words"))
    other = t.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("words").alias("y"))
    return t.join(other, F.col("doc_id") == F.col("a")).select("a", "b", F.round(text.jaccard(F.col("words"), F.col("y")), 6).alias("similarity"))


@query("""SELECT o_orderkey, (o_orderdate + INTERVAL 93 DAY >= TIMESTAMP '1998-08-02') AS recent, (o_orderdate + INTERVAL 186 DAY <= TIMESTAMP '1998-08-02') AS old, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def fn_ages(spark, sf_dir):
    now = F.lit("1998-08-02T00:00:00+02:00")
    when = text.instant(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    t = _of(spark, sf_dir, "orders").select("o_orderkey", when.alias("t"), text.instant(now).alias("now"))
    return t.select("o_orderkey", (F.col("t") + F.expr("INTERVAL 93 DAYS") >= F.col("now")).alias("recent"), (F.col("t") + F.expr("INTERVAL 186 DAYS") <= F.col("now")).alias("old"), F.date_format("t", "yyyy-MM-dd").alias("day"))


@query("""WITH r AS (SELECT p_partkey, '/' || replace(p_name, ' ', '/') || CASE p_partkey % 4 WHEN 0 THEN '/<int:' || p_size || '>' WHEN 1 THEN '/<n' || p_size || '>/<path:rest>' WHEN 2 THEN '' ELSE '/<a>/x/<uuid:b' || p_size || '>' END AS route FROM part),
e AS (SELECT p_partkey, route, list_transform(string_split(route, '<')[2:], lambda x: string_split(x, '>')[1]) AS inner_ FROM r)
SELECT p_partkey, route, array_to_string(list_transform(inner_, lambda x: CASE WHEN contains(x, ':') THEN split_part(x, ':', 2) || ':' || split_part(x, ':', 1) ELSE x || ':string' END), ',') AS params FROM e""")
def fn_url_params(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    end = F.when(k == 0, F.concat(F.lit("/<int:"), size, F.lit(">"))).when(k == 1, F.concat(F.lit("/<n"), size, F.lit(">/<path:rest>"))).when(k == 2, "").otherwise(F.concat(F.lit("/<a>/x/<uuid:b"), size, F.lit(">")))
    t = _of(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/"), F.translate("p_name", " ", "/"), end).alias("route"))
    return t.select("p_partkey", F.array_join(text.url_params(F.col("route")), ",").alias("params"), "route")


@query("SELECT doc_id, rtrim(replace(replace(to_base64(unhex(sha256(text))), '+', '-'), '/', '_'), '=') AS digest FROM documents")
def fn_record_digest(spark, sf_dir):
    return _of(spark, sf_dir, "documents").select("doc_id", text.record_digest(F.encode("text", "utf-8")).alias("digest"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, replace(props, '\\u0000', '') AS clean FROM events")
def fn_json(spark, sf_dir):
    return _of(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.sanitized_json(F.col("props")).alias("clean"))


@query()
def fn_xxhash(spark, sf_dir):
    return _of(spark, sf_dir, "documents").select("doc_id", similarity.xxh32(F.col("text")).alias("xxh32"), similarity.xxh64(F.col("text")).alias("xxh64"))


@query()
def fn_redos(spark, sf_dir):
    from quillon.functions import redos

    patterns = ["(a+)+$", "(a|aa)+", "[a-z]+", "(ab{1,3})*", "(.*)*x", "^(\\d+)*$", "(x|y)*", "("]
    t = _of(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, patterns))).alias("pattern"))
    return t.select("n_nationkey", "pattern", redos.risky(F.col("pattern")).alias("risky"))
