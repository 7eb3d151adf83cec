"""Scans of documents and pages: rules, detections, filters, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import rules
from quillon.operators import detections as det
from quillon.registry import query

_LINES = "lines AS (SELECT source AS scan_id, doc_id AS file_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL)"


def _hits_sql() -> str:
    tests = {
        "secret_token": """regexp_matches(line, '^(?:.*token = "[0-9a-f]{40}")')""",
        "email": "regexp_matches(line, '^(?:(?:.*[^A-Za-z0-9._-])?[a-z0-9._]+@[a-z0-9]+[.][a-z]+)')",
        "ipv4": "regexp_matches(line, '^(?:(?:.*[^0-9.])?[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})')",
        "license": "contains(line, 'icense')",
        "shouting": "regexp_matches(line, '^.*!!.*$', 's')",
        "junk": "regexp_matches(line, '^(?:.*(?:%%%|###|&&&|[$]{3}|[*]{3}))')",
    }
    each = [f"SELECT scan_id, file_id, line_no, line, '{r.id}' AS rule, {r.score} AS score, list_sort({list(r.tags)!r}) AS tags FROM lines WHERE {tests[r.id]}" for r in rules.STRING_RULES]
    return f"""{_LINES}, hits AS ({' UNION ALL '.join(each)}),
found AS (SELECT *, 'StringMatch' AS class, 'string#' || rule || '#' || md5(line) AS signature, score = 0 AS informational,
  CASE WHEN score >= 100 OR list_contains(tags, 'leak:sensitive_file') THEN 'critical'
       WHEN score >= 50 OR list_contains(tags, 'behavior:code_execution') THEN 'high' WHEN score >= 20 THEN 'medium' WHEN score >= 1 THEN 'low' ELSE 'unknown' END AS severity FROM hits),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY scan_id, class, signature ORDER BY file_id, line_no) = 1)"""


HITS = _hits_sql()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.with_severity(det.from_lines(documents(spark, sf_dir), rules.STRING_RULES))


def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.dedup(found(spark, sf_dir))


def _joined(tags: str = "tags"):
    return F.array_join(tags, ",").alias("tags")


@query(f"WITH {HITS} SELECT scan_id, sum(score)::BIGINT AS score, count(*) AS n, count(*) FILTER (severity = 'critical') AS n_critical FROM firsts GROUP BY scan_id")
def scan_score_by_source(spark, sf_dir):
    t = firsts(spark, sf_dir)
    return t.groupBy("scan_id").agg(F.sum("score").cast("long").alias("score"), F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("n_critical"))


@query(f"WITH {HITS} SELECT file_id, line_no, rule, score FROM hits")
def string_rules(spark, sf_dir):
    return det.from_lines(documents(spark, sf_dir), rules.STRING_RULES).select("file_id", "line_no", "rule", "score")


@query(f"WITH {HITS} SELECT scan_id, class, signature, file_id, line_no FROM firsts")
def dedup_signature(spark, sf_dir):
    return firsts(spark, sf_dir).select("scan_id", "class", "signature", "file_id", "line_no")


@query(f"""WITH {HITS} SELECT scan_id, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ('critical', 'high', 'medium', 'low', 'unknown'))} FROM firsts GROUP BY scan_id""")
def severity_histogram(spark, sf_dir):
    return firsts(spark, sf_dir).groupBy("scan_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "unknown")))


@query(f"WITH {HITS} SELECT file_id, line_no, rule FROM firsts WHERE NOT list_contains(tags, 'style') AND len(list_filter(tags, lambda t: starts_with(t, 'leak') OR t = 'network:address')) > 0")
def tag_include_exclude(spark, sf_dir):
    return firsts(spark, sf_dir).where(rules.tag_filter(F.col("tags"), ["Leak*", "network:address", "!style"])).select("file_id", "line_no", "rule")


@query(f"WITH {HITS} SELECT rule, count(*) AS n FROM firsts WHERE NOT (informational AND score = 0) GROUP BY rule")
def verbosity_filter(spark, sf_dir):
    return det.visible(firsts(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {HITS}, good AS (SELECT scan_id FROM firsts GROUP BY scan_id HAVING sum(score) >= 150) SELECT scan_id, rule, count(*) AS n FROM firsts WHERE scan_id IN (SELECT scan_id FROM good) GROUP BY scan_id, rule")
def min_score_having(spark, sf_dir):
    return det.at_least(firsts(spark, sf_dir), 150).groupBy("scan_id", "rule").agg(F.count("*").alias("n"))


_CLOSED = f"""{HITS}, tagged AS (SELECT file_id, list_distinct(flatten(list(tags))) AS tags FROM hits GROUP BY file_id),
closed AS (SELECT file_id, list_sort(list_distinct(list_concat(tags, list_transform(tags, lambda t: split_part(t, ':', 1))))) AS tags FROM tagged)"""


@query(f"""WITH {_CLOSED}, judged AS (SELECT file_id, array_to_string(tags, ',') AS tags,
  list_has_any(tags, ['leak:secret', 'leak:email']) AS leaks_secrets,
  list_contains(tags, 'leak') AND NOT list_contains(tags, 'quality') AS clean_leak,
  list_contains(tags, 'network') AND list_has_any(tags, ['personal_data', 'leak:secret']) AS networked_personal,
  list_contains(tags, 'quality:junk') AND NOT list_has_any(tags, ['leak', 'network']) AS junk_only FROM closed) SELECT * FROM judged""")
def behavior_rules(spark, sf_dir):
    t = det.from_lines(documents(spark, sf_dir), rules.STRING_RULES).groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"))
    t = t.withColumn("tags", rules.with_prefixes(F.col("tags")))
    return t.select("file_id", _joined(), *(rules.behavior(F.col("tags"), tree).alias(k) for k, tree in rules.BEHAVIORS.items()))


@query(f"""WITH {HITS} SELECT scan_id || '/' || file_id AS node, sum(score)::BIGINT AS score, count(*) AS n,
  array_to_string(list_sort(list_distinct(list_filter(flatten(list(tags)), lambda t: t <> 'style'))), ',') AS tags FROM found GROUP BY node""")
def tree_stats(spark, sf_dir):
    t = det.tree_stats(found(spark, sf_dir), F.concat_ws("/", "scan_id", F.col("file_id").cast("string")), ("style",))
    return t.select("node", F.col("score").cast("long").alias("score"), "n", _joined())


@query(f"""WITH {HITS} SELECT scan_id, sum(score)::BIGINT AS score, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags,
  count(DISTINCT file_id) AS n_files, max(severity) AS last_severity FROM firsts GROUP BY scan_id""")
def scan_rollup(spark, sf_dir):
    t = firsts(spark, sf_dir)
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags"))))
    return t.groupBy("scan_id").agg(F.sum("score").cast("long").alias("score"), F.count("*").alias("n"), F.array_join(tags, ",").alias("tags"), F.count_distinct("file_id").alias("n_files"), F.max("severity").alias("last_severity"))


@query(f"WITH {HITS} SELECT h.file_id, h.line_no, h.rule, trim(string_split(d.text, chr(10))[h.line_no]) AS line_text FROM hits h JOIN documents d ON d.doc_id = h.file_id")
def line_lookup(spark, sf_dir):
    """Each finding with its line's text, by a join with the file's text."""
    t = det.from_lines(documents(spark, sf_dir), rules.STRING_RULES).select("file_id", "line_no", "rule")
    text = documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "text")
    return t.join(text, "file_id").select("file_id", "line_no", "rule", F.trim(F.element_at(F.split("text", "\n"), F.col("line_no"))).alias("line_text"))


@query(f"WITH {HITS} SELECT file_id, line_no, rule, score FROM firsts ORDER BY score DESC, file_id, line_no, rule LIMIT 100")
def top_detections(spark, sf_dir):
    return firsts(spark, sf_dir).orderBy(F.col("score").desc(), "file_id", "line_no", "rule").select("file_id", "line_no", "rule", "score").limit(100)


@query("""WITH t AS (SELECT page_id, url, string_split(url, '/') AS parts FROM pages),
tagged AS (SELECT page_id, list_concat(
  CASE WHEN contains(url, '?') THEN ['url:query'] ELSE [] END, CASE WHEN regexp_matches(url, '^[^#]*#') THEN ['url:fragment'] ELSE [] END,
  CASE WHEN len(list_filter(parts, lambda p: p IN ('en', 'fr', 'de', 'es'))) > 0 THEN ['url:language'] ELSE [] END,
  CASE WHEN starts_with(url, 'https://') THEN ['url:secure', 'scheme:https'] ELSE [] END, CASE WHEN starts_with(url, 'http://') THEN ['url:plain', 'scheme:http'] ELSE [] END,
  CASE WHEN parts[-1] = '' THEN ['url:folder'] ELSE [] END, CASE WHEN regexp_matches(url, '^https?://blog[.]') THEN ['site:blog'] ELSE [] END) AS tags FROM t)
SELECT page_id, array_to_string(list_sort(tags), ',') AS tags FROM tagged""")
def file_rules(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("tags", rules.path_tags(F.col("url"), rules.FILE_RULES))
    return t.select("page_id", _joined())


@query("""WITH marked AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, event_type FROM marked WHERE before IS NULL OR before <> event_type""")
def consecutive_dedup(spark, sf_dir):
    """Each user's log without entries of the kind of the one before."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("before", before).where("before IS NULL OR before <> event_type").select("user_id", "event_id", "event_type")
