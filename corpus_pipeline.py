"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, mixing.

Each stage gets what its predecessor kept, drops or weighs documents, and is written before the
next one reads it.

Defined cases, beside those of the operators: a row with a null doc_id passes quality, near copies and leaks by its own text or
unexamined, and counts as a document of its own in the mix; of equal texts it loses to any row with an id.  A null or
empty text scores like a text without words; if it is good, one such row stays, and the mix takes none of it, since it has no words.
Repeated rows are copies of each other: one stays.  Of equally good copies the smallest doc_id stays.  A very long text goes through every
stage whole.  Extra columns, whatever their names, pass through all stages but the last, which has its own columns.  Without documents
there are no rows; without labels the score is the prior 0.5 and nothing is kept; without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspine.llm import decontaminate, exact_dedup, mixing, ngram_join, quality_fm
from larkspine.llm.shared import place, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_fm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_distinct(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar shingles connect."""
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, copies, taken, target of the documents that the mix takes."""
    return mixing.mixed_copies(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing to target weights", mixed),
]

#: SQL cannot express a trained classifier, a recursive similarity join or Newton iterations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's rows are written to the shared folder and read again.

    What a stage wrote is removed when the next one has ended, and its own tables when its rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _through(spark, docs, sf_dir, STAGES)


def _through(spark: SparkSession, docs: DataFrame, sf_dir: str, stages: list) -> DataFrame:
    *before, (name, stage) = stages
    path = place(spark, "pipeline-" + name.replace(" ", "-"))
    with temporary():
        docs = _through(spark, docs, sf_dir, before) if before else docs
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)
