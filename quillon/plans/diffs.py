"""Snapshots compared. Documents of even and of odd place stand for the two sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import rules
from quillon.functions import similarity, text
from quillon.operators import detections as det
from quillon.operators import diff
from quillon.plans.scans import HITS, documents
from quillon.registry import query

_SIDES = """a AS (SELECT source || '/' || doc_id AS path, md5(text) AS md5, text FROM documents WHERE doc_id % 10 < 8),
b AS (SELECT source || '/' || doc_id AS path, md5(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END) AS md5 FROM documents WHERE doc_id % 10 > 1)"""


def _sides(spark, sf_dir):
    d = documents(spark, sf_dir)
    path, part = F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("doc_id") % 10
    other = F.when(part == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.where(part < 8).select(path.alias("path"), F.md5("text").alias("md5"), "text"), d.where(part > 1).select(path.alias("path"), F.md5(other).alias("md5"), other.alias("text"))


@query(f"WITH {_SIDES} SELECT CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'R' ELSE 'M' END AS operation, a.path AS a_ref, b.path AS b_ref, a.md5 AS a_md5, b.md5 AS b_md5 FROM a FULL JOIN b ON a.path = b.path WHERE a.md5 IS DISTINCT FROM b.md5")
def diff_files(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return diff.changed(diff.by_name(left, right))


@query()
def diff_renames(spark, sf_dir):
    """As diff_files, with added and removed files of like content and path as one change."""
    d = documents(spark, sf_dir)
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    left = d.where("doc_id % 2 = 0").select(path.alias("path"), F.md5("text").alias("md5"), "text")
    right = d.where("doc_id % 2 = 1").select(path.alias("path"), F.md5("text").alias("md5"), "text")
    return diff.with_renames(diff.by_name(left, right), left, right).select("operation", "a_ref", "b_ref", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {HITS}, x AS (SELECT line, class, rule, file_id FROM hits, (SELECT 'StringMatch' AS class) WHERE file_id % 2 = 0), y AS (SELECT line, 'StringMatch' AS class, rule, file_id FROM hits WHERE file_id % 2 = 1)
SELECT file_id, rule, true AS is_new FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.line = y.line AND x.rule = y.rule) UNION ALL SELECT file_id, rule, false FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE x.line = y.line AND x.rule = y.rule)""")
def diff_detections(spark, sf_dir):
    t = det.from_lines(documents(spark, sf_dir), rules.STRING_RULES).select("file_id", "rule", "line", "class", "message")
    return diff.detection_changes(t.where("file_id % 2 = 0"), t.where("file_id % 2 = 1")).select("file_id", "rule", "is_new")


@query("""WITH RECURSIVE up(file_id, here, level) AS (SELECT doc_id, doc_id, 0 FROM documents UNION ALL SELECT file_id, here // 3, level + 1 FROM up WHERE level < 5 AND here > 0)
SELECT file_id, arg_min(here, level) AS location, min(level)::INTEGER AS level FROM up WHERE here % 7 = 1 GROUP BY file_id""")
def ancestor_join(spark, sf_dir):
    """Each document's closest ancestor, a third of its number, among the locations of remainder 1 by 7."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"))
    parents = d.where("file_id > 0").select(F.col("file_id").alias("child"), F.floor(F.col("file_id") / 3).alias("parent"))
    return diff.nearest_ancestor(d, d.where("file_id % 7 = 1").select(F.col("file_id").alias("location")), parents)


@query("""WITH f AS (SELECT CASE WHEN doc_id % 97 = 0 THEN 'p' || doc_id || '/setup.py' ELSE 'p/' || doc_id || '.txt' END AS path, rtrim(replace(replace(to_base64(unhex(sha256(text))), '+', '-'), '/', '_'), '=') AS digest, doc_id FROM documents),
r AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE digest END AS digest FROM f WHERE doc_id % 11 <> 0), g AS (SELECT path, digest FROM f WHERE doc_id % 17 <> 0)
SELECT coalesce(r.path, g.path) AS path, CASE WHEN coalesce(r.path, g.path) LIKE '%/setup.py' THEN 'setup_script' WHEN g.path IS NULL THEN 'missing' WHEN r.path IS NULL THEN 'unlisted' ELSE 'bad_digest' END AS problem
FROM r FULL JOIN g ON r.path = g.path WHERE g.path IS NULL OR r.path IS NULL OR r.digest <> g.digest OR r.path LIKE '%/setup.py'""")
def record_integrity(spark, sf_dir):
    path = F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("/setup.py"))).otherwise(F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    f = documents(spark, sf_dir).select(path.alias("path"), text.record_digest(F.encode("text", "utf-8")).alias("digest"), "doc_id")
    r = f.where("doc_id % 11 <> 0").select("path", F.when(F.col("doc_id") % 13 == 0, "x").otherwise(F.col("digest")).alias("digest"))
    return diff.record_check(r, f.where("doc_id % 17 <> 0").select("path", "digest"))


@query()
def phrase_similarity(spark, sf_dir):
    """The share of Lempel-Ziv phrases of neighbouring test items, and the lines that differ."""
    t = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    o = t.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return t.join(o, "item_id").select("item_id", F.round(text.jaccard(similarity.lz_hashes("text"), similarity.lz_hashes("other")), 6).alias("similarity"), F.length(similarity.unified_diff("text", "other")).alias("n_diff"))
