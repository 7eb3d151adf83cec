"""Detections as a star schema, an inverted index of them, and eviction by budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text


def dimension(values: DataFrame, column: str, key: str) -> DataFrame:
    """(key from 1, column) of the distinct values, numbered in their order.

    For dimensions, whose distinct values are few: the numbering sorts them in one task after the distinct.
    """
    t = values.select(column).where(F.col(column).isNotNull()).distinct()
    return t.select(F.row_number().over(Window.orderBy(column)).alias(key), column)


def hash_key(value: Column) -> Column:
    """A key of 60 bits from a text alone, equal in every run and on every machine."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def detection_facts(detections: DataFrame) -> DataFrame:
    """One row a signature and scan, the first by file and line, with its type's and scan's keys."""
    first = F.min(F.struct("file_id", "line_no", "score", "class", "tags")).alias("f")
    t = detections.groupBy("scan_id", "signature").agg(first).select("scan_id", "signature", "f.*")
    # Types are few and numbered; scans are as many as packages, so their key is a hash, which needs no order.
    return t.join(dimension(t, "class", "type_id"), "class").withColumn("scan_key", hash_key(F.col("scan_id")))


def tag_bridge(detections: DataFrame) -> DataFrame:
    """(scan_id, signature, tag), each once."""
    return detections.select("scan_id", "signature", F.explode("tags").alias("tag")).distinct()


STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def inverted_index(table: DataFrame, key: str, column: str) -> DataFrame:
    """(term, n_docs, n): how many rows hold each lower-cased word of ASCII letters and digits, and how often."""
    words = F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    each = table.select(key, F.explode(words).alias("term")).groupBy("term", key).agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


def evicted(items: DataFrame, budget: int, now, by: tuple[str, ...] = ()) -> DataFrame:
    """What a cache of (item, size, expires) drops: all that has expired, then the largest until the rest fits ``budget``."""
    keys = list(by)
    live = Window.partitionBy(*keys).orderBy(F.col("size").desc(), "item") if keys else Window.orderBy(F.col("size").desc(), "item")
    gone = F.col("expires") < now
    size = F.when(gone, 0).otherwise(F.col("size"))
    total = F.sum(size).over(Window.partitionBy(*keys))
    before = F.sum(size).over(live.rowsBetween(Window.unboundedPreceding, -1))
    return items.withColumn("gone", gone | (total - F.coalesce(before, F.lit(0)) > budget)).where("gone").drop("gone")


def components(packages: DataFrame) -> DataFrame:
    """(purl, name, version, description): packages as parts of a bill of materials; without a description, the summary."""
    return packages.select(text.purl(F.col("name"), F.col("version")).alias("purl"), text.canonical(F.col("name")).alias("name"), "version", F.coalesce(F.when(F.trim("description") != "", F.col("description")), F.col("summary")).alias("description"))
