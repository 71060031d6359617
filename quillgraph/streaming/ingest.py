"""Documents as a stream: new content once, and a knowledge base that follows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.functions.text import content_hash

LATE = "1 hour"


def text_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Whole files of a folder as they appear: ``source, doc_type, seq, content, metadata, seen_at``."""
    raw = spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", max_files).format("text").load(folder)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.lit("txt").alias("doc_type"), F.lit(0).cast("long").alias("seq"), F.col("value").alias("content"), F.create_map(F.lit("filename"), F.col("_metadata.file_name")).alias("metadata"), F.col("_metadata.file_modification_time").alias("seen_at"))


def new_content(segments: DataFrame, late: str = LATE) -> DataFrame:
    """Segments whose normalised content was not seen within ``late``; the state is a hash each and expires."""
    s = segments.where(F.coalesce(F.trim("content"), F.lit("")) != "").withColumn("content_hash", content_hash(F.col("content")))
    return s.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["content_hash"])


def ingest_stream(segments: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hand each micro-batch to ``sink(batch, number)``; sinks upsert by key, so a repeated batch changes nothing."""
    writer = new_content(segments).drop("content_hash", "seen_at").writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type in tumbling windows, closed ``late`` after their end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
