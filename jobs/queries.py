"""The jobs as registered queries: each runs its function twice into a new folder of the shared one and returns what it finds there."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import chunk_corpus, sync_documents
from jobs.settings import settings
from larkspine.plans.base import shared_folder, tok_a

HERE = Path(__file__).parent


def job1_chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_folder(spark)}/job1-chunk-corpus-{uuid.uuid4().hex}"
    chosen = settings(chunk_corpus.Settings, HERE / "chunk_corpus.json")
    for _ in range(2):
        chunk_corpus.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, chosen)
    return chunk_corpus.current(spark, out).select("chunk_id", "doc_id", "chunk_index", "lang", "source", "chunk", "n_terms", "n_copies")


def job2_sync_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_folder(spark)}/job2-sync-documents-{uuid.uuid4().hex}"
    chosen = settings(sync_documents.Settings, HERE / "sync_documents.json")
    for _ in range(2):
        sync_documents.run(spark, f"{sf_dir}/documents.parquet", f"{out}/store", f"{out}/checkpoint", chosen)
    return sync_documents.current(spark, f"{out}/store").select("chunk_id", "doc_id", "chunk_index", "chunk", "action", "version", "content_hash", "n_chunks")


QUERIES = {f.__name__: f for f in (job1_chunk_corpus, job2_sync_documents)}

_CUT = """
    c AS (SELECT doc_id, lang, source, text, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(i * 400 + 1 AS BIGINT), 500) AS chunk
          FROM (SELECT *, unnest(range(CAST(greatest(ceil((length(text) - 500) / 400.0), 0) AS BIGINT) + 1)) AS i FROM d WHERE length(text) > 0) x)"""
_ID = "doc_id::VARCHAR || '_chunk_' || chunk_index::VARCHAR || '_' || substring(md5(chunk), 1, 8) AS chunk_id"

SQL = {
    "job1_chunk_corpus": f"""
        WITH d AS (
            SELECT doc_id, coalesce(nullif(lang, ''), 'und') AS lang, source, text FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_CUT},
        o AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, chunk_index) AS r, count(*) OVER (PARTITION BY chunk) AS n_copies FROM c)
        SELECT {_ID}, doc_id, chunk_index, lang, source, chunk, CAST(len({tok_a("chunk")}) AS INTEGER) AS n_terms, n_copies FROM o WHERE r = 1""",
    "job2_sync_documents": f"""
        WITH d AS (SELECT doc_id, lang, source, text FROM documents), {_CUT}
        SELECT {_ID}, doc_id, chunk_index, chunk, 'CREATED' AS action, CAST(1 AS INTEGER) AS version, md5(text) AS content_hash,
               CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_chunks
        FROM c""",
}
