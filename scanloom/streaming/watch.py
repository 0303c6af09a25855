"""Continuous scanning and trends with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.operators.incremental import IncrementalStore
from scanloom.operators.rules import RULES, Rule, scan
from scanloom.workdir import materialise


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, rules: tuple[Rule, ...] = RULES, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Scan text files as they arrive or change in a folder; findings go to an ``IncrementalStore``.

    A micro-batch's files are added to those the store knows; the store gives only new and changed ones to the scan
    and publishes findings and tree together, so a batch that is run again after a failure adds nothing.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
        .select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("at"))
    )

    def batch(df: DataFrame, _: int) -> None:
        s = IncrementalStore(df.sparkSession, store)
        latest = materialise(df.groupBy("file_path").agg(F.max_by("content", "at").alias("content")).withColumn("content_hash", F.sha2("content", 256)), "batch")
        current = latest.select("file_path", "content_hash")
        if s.version():
            known = s.entries().select(F.col("key").alias("file_path"), F.col("value").alias("content_hash"))
            current = current.unionByName(known.join(latest, "file_path", "left_anti"))
        s.run(current, "file_path", "content_hash", lambda todo: scan(latest.join(todo.select("file_path"), "file_path", "left_semi"), rules))

    q = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime=every)).start()


def trend(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type of an event stream (ts, event_type, value); later events are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def rescan_on_change(spark: SparkSession, folder: str, checkpoint: str, handler: Callable[[DataFrame, int], None], every: str = "2 seconds") -> StreamingQuery:
    """Call ``handler`` with each micro-batch of lines (file_path, line) that arrives in a folder."""
    lines = spark.readStream.format("text").load(folder).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))
    return lines.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
