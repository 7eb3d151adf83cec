"""The queue worker as a stream: URIs or texts arrive as files, each batch is scanned once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon import rules
from quillon.operators import detections as det


def queue(spark: SparkSession, folder: str, schema: str, most_files: int = 100) -> DataFrame:
    """Rows of the parquet files that come into ``folder``, the newest first; a file is claimed once, by the stream's offsets."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).option("latestFirst", True).parquet(folder)


def scanned(docs: DataFrame) -> DataFrame:
    """Detections of streamed documents (doc_id, text, source)."""
    return det.with_severity(det.from_lines(docs, rules.STRING_RULES))


def unseen(detections: DataFrame, when: str, delay: str = "1 day") -> DataFrame:
    """Without repeats of a signature in a scan within ``delay``; state is dropped with the watermark."""
    return detections.withWatermark(when, delay).dropDuplicatesWithinWatermark(["scan_id", "class", "signature"])


def windowed_counts(events: DataFrame, when: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(event_type, start, n): counts by window; what is later than ``late`` is left out."""
    t = events.withWatermark(when, late).groupBy("event_type", F.window(when, size).alias("w")).agg(F.count("*").alias("n"))
    return t.select("event_type", F.col("w.start").alias("start"), "n")


def work(docs: DataFrame, target: str, checkpoint: str, once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Scans each batch and writes its detections; a batch that is done again after a failure replaces what it wrote."""

    def scan(batch: DataFrame, number: int) -> None:
        det.dedup(scanned(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(scan)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
