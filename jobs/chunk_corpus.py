"""Builds the chunk corpus of a knowledge base from documents.

    python -m jobs.chunk_corpus --documents DIR --labels DIR --out DIR [--config FILE]

Reads documents (doc_id, text, lang, source) and labels (doc_id, toxic); leaves out documents that are labelled toxic; cuts texts
into overlapping slices; keeps one of equal slices, that of the smallest (doc_id, chunk_index), with the number of its copies; gives
it an id, its document's metadata and its length in terms.  Writes Parquet under ``out``:

* ``chunks/lang=..``: chunk_id, doc_id, chunk_index, source, chunk, metadata, n_terms, n_copies; sorted by document within a file.
* ``report/``: rows, terms and copies by lang and source, as JSON, with the run's number.

A run replaces the partitions of the languages it finds, each when all its files are written, and then the report, whose number says which
rows count: rows of a language that is no longer there don't.  So it can be run again at any time with the same result.  After a run that
died the rows of partitions it had replaced are missing until the next one.

Defined cases: null and empty texts have no slices.  A null or empty lang is ``und``.  Documents with a null doc_id are left out, since
their chunks could not be named; equal rows count as copies of each other.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import command_line, log
from larkspine.functions.text import tokens_basic
from larkspine.operators import chunkers, incremental, index

CHUNKS = "chunk_id string, doc_id long, chunk_index int, source string, chunk string, metadata map<string,string>, n_terms int, n_copies long, run int, lang string"
REPORT = "run int, lang string, source string, chunks long, terms long, copies long"


@dataclass(frozen=True)
class Settings:
    size: int = 500
    overlap: int = 100
    drop_toxic: bool = True
    #: Files that a language is dealt to by document, so that no language is one task; a file has so many rows at most.
    files_per_lang: int = 8
    records_per_file: int = 1_000_000


def chunks(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """The rows of CHUNKS, dealt as they are written: by language and a hash of the document.

    What follows from the slice (id, metadata, terms) is added after the last shuffle.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("und")).alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null and text is not null")
    if settings.drop_toxic:
        docs = docs.join(labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti")
    cut = chunkers.exploded(docs, chunkers.slices(F.col("text"), settings.size, settings.overlap))
    # The first place of a slice as one number, so that slices are combined in a hash map before they are shuffled: a slice that many
    # documents have is a row a task.
    big = F.lit(str(1 << 31)).cast("decimal(11,0)")
    place = (F.col("doc_id").cast("decimal(20,0)") * big + F.col("chunk_index")).cast("decimal(38,0)")
    once = cut.groupBy("chunk").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n_copies"))
    index_of = F.pmod("place", big).cast("int")
    placed = once.select(((F.col("place") - index_of) / big).cast("long").alias("doc_id"), index_of.alias("chunk_index"), "chunk", "n_copies")
    of_document = docs.groupBy("doc_id").agg(F.min(F.struct("lang", "source")).alias("of")).select("doc_id", "of.*")
    own = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    base = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.coalesce("source", F.lit("")))
    dealt = placed.join(of_document, "doc_id").repartition("lang", F.pmod(F.xxhash64("doc_id"), F.lit(settings.files_per_lang)))
    return dealt.select(
        incremental.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk")).alias("chunk_id"),
        "doc_id",
        "chunk_index",
        "source",
        "chunk",
        index.enrich(base, F.col("doc_id"), F.col("chunk"), own).alias("metadata"),
        F.size(tokens_basic(F.col("chunk"))).alias("n_terms"),
        "n_copies",
        "lang",
    )


def last_run(spark: SparkSession, out: str) -> int:
    """The number of the last run that ended; 0 before the first."""
    try:
        return spark.read.schema(REPORT).json(f"{out}/report").agg(F.max("run")).first()[0] or 0
    except AnalysisException:  # there is no report yet
        return 0


def current(spark: SparkSession, out: str) -> DataFrame:
    """The corpus as the last run left it; languages that it did not find are not in it."""
    return spark.read.schema(CHUNKS).parquet(f"{out}/chunks").where(F.col("run") == last_run(spark, out)).drop("run")


def run(spark: SparkSession, documents: str, labels: str, out: str, settings: Settings = Settings()) -> dict[str, int]:
    """Builds the corpus; counts of what was read and written."""
    number = last_run(spark, out) + 1
    docs = spark.read.parquet(documents)
    rows = chunks(docs, spark.read.parquet(labels), settings).withColumn("run", F.lit(number))
    rows.sortWithinPartitions("lang", "doc_id", "chunk_index").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", settings.records_per_file).partitionBy("lang").parquet(f"{out}/chunks")
    written = spark.read.schema(CHUNKS).parquet(f"{out}/chunks").where(F.col("run") == number)
    report = written.groupBy("run", "lang", "source").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_terms").alias("terms"), F.sum(F.col("n_copies") - 1).alias("copies"))
    report.coalesce(1).write.mode("overwrite").json(f"{out}/report")
    made = spark.read.schema(REPORT).json(f"{out}/report").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.col("chunks") + F.col("copies")), F.lit(0)).alias("slices"))
    got = {"documents": docs.count(), **made.first().asDict()}
    log.info("chunk_corpus read %d documents from %s", got["documents"], documents)
    log.info("chunk_corpus wrote %d chunks of %d slices to %s, run %d", got["chunks"], got["slices"], out, number)
    return got


if __name__ == "__main__":
    paths = {"documents": "table of doc_id, text, lang, source", "labels": "table of doc_id, toxic", "out": "folder of the corpus"}
    command_line("chunk_corpus", paths, run, Settings, Path(__file__).with_suffix(".json"), sys.argv[1:])
