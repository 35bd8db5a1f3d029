"""Writing: chunk tables to a vector and a keyword store from one lineage, the registry, and upload reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspine.functions.models import Embedder, embed
from larkspine.operators.index import enrich, postings, segment_ids


def index_documents(docs: DataFrame, chunks: DataFrame, embedder: Embedder, metadata: Column | None = None) -> DataFrame:
    """id, doc_id, content, embedding, metadata of chunks (doc_id, chunk_index, chunk); the documents' metadata stays."""
    base = F.coalesce(metadata, F.create_map().cast("map<string,string>")) if metadata is not None else F.create_map().cast("map<string,string>")
    rows = chunks.join(docs.withColumn("_meta", base).select("doc_id", "_meta"), "doc_id")
    own = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    return rows.select(segment_ids(F.col("doc_id"), F.col("chunk_index")).alias("id"), "doc_id", F.col("chunk").alias("content"), embed(embedder, F.col("chunk")).alias("embedding"), enrich(F.col("_meta"), F.col("doc_id"), F.col("chunk"), own).alias("metadata"))


def dual_write(index: DataFrame, vectors: str, keywords: str) -> None:
    """The index once for vectors, then postings from the table just written, so nothing is embedded twice."""
    index.write.mode("overwrite").parquet(vectors)
    back = index.sparkSession.read.parquet(vectors)
    postings(back, id_col="id", text="content").write.mode("overwrite").parquet(keywords)


def replace_documents(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of documents that come anew are replaced."""
    return existing.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


def delete_documents(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("doc_id"), "doc_id", "left_anti")


def save_registry(registry: DataFrame, path: str, version: int) -> str:
    """A new version's folder; readers switch when it is complete."""
    to = f"{path}/v={version:08d}"
    registry.write.mode("overwrite").json(to)
    return to


def upload_report(results: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed and the names that failed; results: filename, error."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("filename")))).alias("failed_names"))


def clear(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
