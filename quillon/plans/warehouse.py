"""Detections for reports and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import warehouse as wh
from quillon.plans.scans import HITS, documents, firsts, found
from quillon.registry import query
from quillon.sinks import formats


@query(f"""WITH {HITS}, kinds AS (SELECT class, row_number() OVER (ORDER BY class) AS type_id FROM (SELECT DISTINCT class FROM firsts))
SELECT ('0x' || substr(md5(scan_id), 1, 15))::BIGINT AS scan_key, type_id::INTEGER AS type_id, signature, score, file_id FROM firsts JOIN kinds USING (class)""")
def star_detections(spark, sf_dir):
    return wh.detection_facts(found(spark, sf_dir)).select("scan_key", "type_id", "signature", "score", "file_id")


@query(f"WITH {HITS}, t AS (SELECT DISTINCT unnest(tags) AS tag FROM firsts) SELECT row_number() OVER (ORDER BY tag)::INTEGER AS tag_id, tag FROM t")
def dim_tags(spark, sf_dir):
    return wh.dimension(wh.tag_bridge(found(spark, sf_dir)), "tag", "tag_id")


@query(f"WITH {HITS}, b AS (SELECT DISTINCT scan_id, signature, unnest(tags) AS tag FROM found) SELECT scan_id, tag, count(*) AS n FROM b GROUP BY scan_id, tag")
def tag_bridge(spark, sf_dir):
    return wh.tag_bridge(found(spark, sf_dir)).groupBy("scan_id", "tag").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN {wh.STOP_WORDS!r})) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM w GROUP BY term""")
def inverted_index(spark, sf_dir):
    return wh.inverted_index(documents(spark, sf_dir), "doc_id", "text")


@query("""WITH i AS (SELECT o_custkey, o_orderkey AS item, floor(o_totalprice)::BIGINT AS size, o_orderdate < TIMESTAMP '1993-01-01' AS gone FROM orders),
r AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE size END) OVER (PARTITION BY o_custkey) AS total, coalesce(sum(CASE WHEN gone THEN 0 ELSE size END) OVER (PARTITION BY o_custkey ORDER BY size DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i)
SELECT o_custkey, item, size FROM r WHERE gone OR total - before > 500000""")
def cache_eviction(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.col("o_orderkey").alias("item"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").alias("expires"))
    return wh.evicted(t, 500000, F.lit("1993-01-01").cast("timestamp_ntz"), ("o_custkey",)).select("o_custkey", "item", "size")


@query("SELECT 'pkg:pypi/' || lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) || '@' || p_size AS purl, lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) AS name, p_size::VARCHAR AS version, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS description FROM part")
def sbom_components(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.when(F.col("p_partkey") % 3 != 0, F.lit(" ")).otherwise(F.col("p_type")).alias("description"), F.col("p_brand").alias("summary"))
    return wh.components(t)


@query(f"""WITH {HITS} SELECT file_id, line_no, '{{"score":' || score || ',"type":"StringMatch","slug":"stringmatch","severity":"' || severity || '","line_no":' || line_no || ',"signature":"' || signature || '"}}' AS json FROM firsts""")
def detections_json(spark, sf_dir):
    return firsts(spark, sf_dir).select("file_id", "line_no", formats.detection_json(with_text=False).alias("json"))


@query(f"""WITH {HITS} SELECT scan_id, list_sort(list(DISTINCT file_id))::VARCHAR AS artifacts, count(*) AS n_results FROM firsts GROUP BY scan_id""")
def sarif_artifacts(spark, sf_dir):
    t = firsts(spark, sf_dir).groupBy("scan_id").agg(F.array_sort(F.collect_set("file_id")).alias("a"), F.count("*").alias("n_results"))
    return t.select("scan_id", F.concat(F.lit("["), F.array_join("a", ", "), F.lit("]")).alias("artifacts"), "n_results")


@query("SELECT page_id, count(*) AS n_links, min(lower(regexp_replace(a, '[-_.]+', '-', 'g'))) AS first_name FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*>([^<]*)</a>', 1)) AS a FROM pages) GROUP BY page_id")
def simple_index(spark, sf_dir):
    """Names in the links of an index page."""
    from quillon.functions.text import canonical

    t = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<a[^>]*>([^<]*)</a>"), F.lit(1))).alias("a"))
    return t.groupBy("page_id").agg(F.count("*").alias("n_links"), F.min(canonical(F.col("a"))).alias("first_name"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Events by hour and type; the streaming worker has the same windows."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select("event_type", F.col("w.start").alias("start"), "n", "users")
