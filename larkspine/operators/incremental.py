"""Incremental import: a document registry kept in step with incoming documents by content hash.

Registry rows: document_id, content_hash, status, version, storage_type, index_time, update_time.
Incoming rows: document_id, content (null: its import failed), storage_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE, DELETED = "ACTIVE", "DELETED"


def content_hash(content: Column, algorithm: str = "md5") -> Column:
    return F.md5(content) if algorithm == "md5" else F.sha2(content, 256)


def active(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("status") != DELETED)


def in_folder(folder: str, of: str = "document_id") -> Column:
    """Whether an id is ``folder/...``; a bare prefix is not enough."""
    return F.col(of).startswith(folder.rstrip("/") + "/")


def needs_update(registry: DataFrame, current: DataFrame) -> DataFrame:
    """document_id, needs_update: missing in the registry, or with another hash."""
    r = active(registry).select("document_id", F.col("content_hash").alias("known"))
    return current.join(r, "document_id", "left").select("document_id", (~F.col("content_hash").eqNullSafe(F.col("known"))).alias("needs_update"))


def plan(registry: DataFrame, incoming: DataFrame, folder: str | None = None, force: bool = False) -> DataFrame:
    """document_id, action, content_hash, version for every document of either side that an import concerns.

    CREATED (version 1), UPDATED (version + 1), SKIPPED (same hash), FAILED (no content), DELETED (active in the
    folder, but neither imported nor failed).  A deleted document that comes again is UPDATED.
    """
    inc = incoming.select("document_id", content_hash(F.col("content")).alias("new_hash"), F.col("content").isNull().alias("failed"), F.lit(True).alias("came"))
    reg = registry.select("document_id", F.col("content_hash").alias("old_hash"), "status", F.col("version").alias("old_version"))
    both = inc.join(reg, "document_id", "full_outer")
    gone = F.lit(False) if folder is None else in_folder(folder) & (F.col("status") != DELETED)
    came = F.coalesce("came", F.lit(False))
    action = (
        F.when(came & F.col("failed"), "FAILED")
        .when(came & F.col("old_version").isNull(), "CREATED")
        .when(came & (F.lit(force) | (F.col("status") == DELETED) | ~F.col("new_hash").eqNullSafe(F.col("old_hash"))), "UPDATED")
        .when(came, "SKIPPED")
        .when(gone, "DELETED")
    )
    rows = both.withColumn("action", action).where("action is not null")
    version = F.when(F.col("action").isin("CREATED", "UPDATED"), F.coalesce("old_version", F.lit(0)) + 1).otherwise(F.col("old_version"))
    return rows.select("document_id", "action", F.coalesce("new_hash", "old_hash").alias("content_hash"), version.alias("version"))


def counters(planned: DataFrame) -> DataFrame:
    """One row: total, created, updated, skipped, deleted, failed."""
    one = lambda a: F.count_if(F.col("action") == a).alias(a.lower())
    return planned.agg(F.count_if(F.col("action") != "DELETED").alias("total"), *map(one, ("CREATED", "UPDATED", "SKIPPED", "DELETED", "FAILED")))


def apply(registry: DataFrame, planned: DataFrame, storage_type: str = "memory", physical: bool = False, now: Column | None = None) -> DataFrame:
    """The registry after a plan; ``physical`` removes deleted rows instead of marking them."""
    now = now if now is not None else F.current_timestamp()
    done = planned.where("action <> 'FAILED'").select("document_id", "action", F.col("content_hash").alias("_hash"), F.col("version").alias("_version"))
    both = registry.join(done, "document_id", "full_outer")
    changed = F.col("action").isin("CREATED", "UPDATED")
    out = both.select(
        "document_id",
        F.when(changed, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(changed, ACTIVE).when(F.col("action") == "DELETED", DELETED).otherwise(F.col("status")).alias("status"),
        F.when(changed, F.col("_version")).otherwise(F.col("version")).alias("version"),
        F.coalesce("storage_type", F.lit(storage_type)).alias("storage_type"),
        F.coalesce("index_time", now).alias("index_time"),
        F.when(changed | (F.col("action") == "DELETED"), now).otherwise(F.col("update_time")).alias("update_time"),
    )
    return out.where(F.col("status") != DELETED) if physical else out


def delete(registry: DataFrame, ids: DataFrame, physical: bool = False) -> DataFrame:
    if physical:
        return registry.join(ids, "document_id", "left_anti")
    gone = ids.select("document_id", F.lit(True).alias("_gone")).distinct()
    marked = registry.join(gone, "document_id", "left")
    return marked.withColumn("status", F.when(F.col("_gone"), DELETED).otherwise(F.col("status"))).drop("_gone")


def status(registry: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """document_id, status, version and, where a current hash is given, whether the content changed."""
    rows = registry.select("document_id", "status", "version", "content_hash")
    if current is None:
        return rows
    cur = current.select("document_id", F.col("content_hash").alias("now_hash"))
    return rows.join(cur, "document_id", "left").withColumn("changed", F.when(F.col("now_hash").isNotNull(), F.col("now_hash") != F.col("content_hash"))).drop("now_hash")


def by_hash(registry: DataFrame, value: str) -> DataFrame:
    return registry.where(F.col("content_hash") == value).orderBy("document_id").limit(1)


def chunk_id(doc_id: Column, position: Column, chunk: Column) -> Column:
    """``doc_chunk_i_hash`` with a suffix from the chunk itself, so reruns agree."""
    return F.concat_ws("_", doc_id.cast("string"), F.lit("chunk"), position.cast("string"), F.substring(F.md5(chunk), 1, 8))


def chunk_rows(chunks: DataFrame, storage_type: str = "memory") -> DataFrame:
    """Chunk ids and their metadata."""
    return chunks.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk")).alias("chunk_id"),
        F.create_map(F.lit("document_id"), F.col("doc_id").cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("storage_type"), F.lit(storage_type)).alias("metadata"),
        "chunk",
    )


def replace_chunks(index: DataFrame, planned: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk table (document_id, ...) after a plan without states in between: chunks of documents that are updated or deleted go first,
    then those of created and updated ones come."""
    gone = planned.where(F.col("action").isin("UPDATED", "DELETED")).select("document_id")
    come = planned.where(F.col("action").isin("CREATED", "UPDATED")).select("document_id")
    return index.join(gone, "document_id", "left_anti").unionByName(fresh.join(come, "document_id", "left_semi"))


def rebuild(registry: DataFrame, documents: DataFrame, chunker) -> DataFrame:
    """Chunks of all active documents anew."""
    return chunker(documents.join(active(registry).select("document_id"), "document_id", "left_semi"))
