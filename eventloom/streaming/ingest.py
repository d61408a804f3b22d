"""Structured Streaming: idempotent event ingest, windowed counts, and incremental co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import cooccurrence_edges


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(events: DataFrame, at: str = "ts", key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once; state older than the watermark is dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, at: str = "ts", length: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    w = F.window(at, length, slide or length)
    return events.withWatermark(at, late).groupBy(w, by).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))


def append_edges(participation: DataFrame, table: str, checkpoint: str):
    """Each micro-batch appends its pair counts as a delta; readers sum the deltas of (a, b). Returns the running query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cooccurrence_edges(batch, rows=batch.count()).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return participation.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summed_edges(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy("a_id", "b_id").agg(F.sum("event_count").alias("event_count"))
