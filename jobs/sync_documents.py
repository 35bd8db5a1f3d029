"""Keeps a chunk store in step with a folder of documents that grows: a stream of files, taken up where the last run ended.

    python -m jobs.sync_documents --documents DIR --out DIR --checkpoint DIR [--config FILE]

Files of documents (doc_id, text) that came since the last run are taken in batches of ``files_per_batch``; the stream's checkpoint
knows which.  Of rows of one document in a batch the one of the newest file counts (ties: the smallest text).  The document's content hash is
held against the registry: a document is CREATED, UPDATED (its version rises), SKIPPED where the content is the same, or FAILED without a
text.  A run ends when all files that were there at its start are taken.  It writes Parquet under ``out``, as logs to which every batch
adds:

* ``registry/batch=../bucket=..``: document_id, action, content_hash, version, n_chunks of documents that were created or updated or failed.
* ``chunks/batch=../bucket=..``: the chunks of those created or updated.

A batch reads only what batches before it wrote and replaces its own partitions, so one that is run again after a failure writes the
same; chunks are written before the registry, and only chunks that the registry names count (``current``).  Buckets deal documents
by a hash of their ids, so no document's name or source makes a hot file; the columns of the registry that a batch compares are
few, and only documents of the batch are looked up.

Defined cases: a null doc_id is left out.  An empty text is a document without chunks.  A document whose files come out of order within
one run has the newest file's text if they are in one batch, else the text of the later batch.  Documents that are no longer in the folder
stay: the stream sees what comes.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import command_line, log
from larkspine.operators import chunkers, incremental

REGISTRY = "document_id string, doc_id long, action string, content_hash string, version int, n_chunks int, batch long, bucket int"
CHUNKS = "chunk_id string, doc_id long, chunk_index int, chunk string, batch long, bucket int"


@dataclass(frozen=True)
class Settings:
    size: int = 500
    overlap: int = 100
    storage_type: str = "memory"
    files_per_batch: int = 1000
    buckets: int = 16


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def registry(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The last state of each document, or its last before a batch; failures leave a document as it was."""
    rows = table(spark, f"{out}/registry", REGISTRY).where("action <> 'FAILED'")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = F.max(F.struct("version", "batch", "action", "content_hash", "n_chunks")).alias("last")
    return rows.groupBy("document_id", "doc_id").agg(last).select("document_id", "doc_id", "last.*")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks that count, with their document's action, version and content hash; documents without chunks are not in it."""
    state = registry(spark, out)
    return table(spark, f"{out}/chunks", CHUNKS).drop("bucket").join(state.select("doc_id", "batch", "action", "version", "content_hash", "n_chunks"), ["doc_id", "batch"])


def take(batch: DataFrame, number: int, out: str, settings: Settings) -> dict[str, int]:
    """Writes what a batch of rows (doc_id, text, came) changes; how many documents were created, updated, skipped, failed."""
    spark = batch.sparkSession
    rows = batch.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "came")
    newest = rows.groupBy("doc_id").agg(F.min(F.struct((-F.unix_micros("came")).alias("age"), "text")).alias("it"))
    incoming = newest.select(F.col("doc_id").cast("string").alias("document_id"), F.col("it.text").alias("content"), F.lit(settings.storage_type).alias("storage_type"))
    known = registry(spark, out, number).select("document_id", "content_hash", F.lit(incremental.ACTIVE).alias("status"), "version")
    known = known.join(incoming.select("document_id"), "document_id", "left_semi")
    planned = incremental.plan(known, incoming)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(settings.buckets)).cast("int")
    changed = planned.where("action in ('CREATED', 'UPDATED')").select("document_id", "action", "content_hash", "version").join(incoming, "document_id")
    texts = changed.select(F.col("document_id").cast("long").alias("doc_id"), F.col("content").alias("text"))
    cut = chunkers.exploded(texts, chunkers.slices(F.col("text"), settings.size, settings.overlap))
    named = cut.select(incremental.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk")).alias("chunk_id"), "doc_id", "chunk_index", "chunk", F.lit(number).alias("batch"), bucket.alias("bucket"))
    _write(named, f"{out}/chunks", settings.buckets)
    n = table(spark, f"{out}/chunks", CHUNKS).where(F.col("batch") == number).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    log_rows = planned.where("action <> 'SKIPPED'").withColumn("doc_id", F.col("document_id").cast("long")).join(n, "doc_id", "left")
    _write(log_rows.select("document_id", "doc_id", "action", "content_hash", F.col("version").cast("int").alias("version"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lit(number).alias("batch"), bucket.alias("bucket")), f"{out}/registry", settings.buckets)
    # Counted from what was written, so the texts are not compared once more.
    logged = dict(table(spark, f"{out}/registry", REGISTRY).where(F.col("batch") == number).groupBy("action").count().collect())
    got = {"total": rows.select("doc_id").distinct().count(), **{a.lower(): logged.get(a, 0) for a in ("CREATED", "UPDATED", "SKIPPED", "DELETED", "FAILED")}}
    return got | {"skipped": got["total"] - sum(logged.values())}


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    dealt = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Takes the files that came since the last run with this checkpoint; counts over its batches."""
    total = {"batches": 0, "total": 0, "created": 0, "updated": 0, "skipped": 0, "deleted": 0, "failed": 0}

    def one(batch: DataFrame, number: int) -> None:
        got = take(batch, number, out, settings)
        log.info("sync_documents batch %d read %d documents of %s, wrote %s", number, got["total"], documents, {k: v for k, v in got.items() if k != "total"})
        for k, v in got.items():
            total[k] += v
        total["batches"] += 1

    # As a pattern, because a stream takes a plain path for a folder, while this may be one file.
    found = documents if any(c in documents for c in "*?[{") else f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]"
    files = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", settings.files_per_batch).parquet(found)
    rows = files.select("doc_id", "text", F.col("_metadata.file_modification_time").alias("came"))
    stream = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("sync_documents took %d batches into %s: %s", total["batches"], out, total)
    return total


if __name__ == "__main__":
    paths = {"documents": "folder of files with doc_id, text", "out": "folder of the store", "checkpoint": "the stream's checkpoint"}
    command_line("sync_documents", paths, run, Settings, Path(__file__).with_suffix(".json"), sys.argv[1:])
