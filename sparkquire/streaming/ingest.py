"""Incremental ingestion by Structured Streaming, and windows over an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow_files(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands new files (path, mtime, length, content) of a folder to ``handle`` in batches, each file
    once across restarts, and stops when all there are have been read."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kinds).option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", F.col("modificationTime").alias("mtime"), "length", "content", F.sha2("content", 256).alias("sha256"))
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that keeps the latest row of each key in a table; a batch that is handled again
    after a crash changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The latest row of each key over all batches."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("x")).select("x.*")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of one file, its times as instants."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, events, value) of runs of a user's events less than ``gap`` apart; on a
    stream, state of sessions older than ``late`` is dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, events, value) of tumbling windows."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """A finite stream, run to its end in append mode into a table, read back."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
