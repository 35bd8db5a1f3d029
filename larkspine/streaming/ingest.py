"""Streaming ingest: files that arrive become chunks of the index, each document version once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspine.operators.incremental import content_hash


def arrivals(spark: SparkSession, path: str, schema: str, watermark: str = "1 hour") -> DataFrame:
    """Documents (document_id, content, ts) without repeats of the same content within the watermark."""
    rows = spark.readStream.schema(schema).parquet(path)
    hashed = rows.withColumn("content_hash", content_hash(F.col("content")))
    return hashed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["document_id", "content_hash"])


def ingest(stream: DataFrame, chunker: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Chunks every batch into ``out``, partitioned by batch: a batch that is repeated replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        chunker(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Windowed counts and sums per event type; late rows beyond the watermark are left out when streaming."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
