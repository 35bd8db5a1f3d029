"""Index building, chunking and incremental import as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspine.functions.text import tokens_basic
from larkspine.operators import chunkers, incremental, index
from larkspine.plans.base import Tables, query, tok_a, tok_b
from larkspine.plans.queries_retrieval import cosine_sql

TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"

# Index tables


POSTINGS = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok_a('text')}) AS term FROM documents) x GROUP BY 1, 2"


@query("s14_postings_tf", POSTINGS)
def postings(t: Tables) -> DataFrame:
    return index.postings(t.documents)


@query("s15_postings_distinct", f"SELECT doc_id, term, 1::BIGINT AS tf FROM (SELECT doc_id, unnest({tok_b('text')}) AS term FROM documents) x")
def postings_distinct(t: Tables) -> DataFrame:
    return index.postings(t.documents, distinct=True)


@query("g2_document_frequency", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tok_a('text')}) AS term FROM documents) x GROUP BY 1")
def df(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.array_distinct(tokens_basic(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("g3_average_length", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS avgdl FROM documents GROUP BY 1")
def avgdl(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("avgdl"))


@query("j2_postings_documents", f"SELECT p.doc_id, source, sum(tf)::BIGINT AS tokens FROM (SELECT doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({tok_a('text')}) AS term FROM documents) x GROUP BY doc_id, term) p JOIN documents USING (doc_id) GROUP BY 1, 2")
def postings_docs(t: Tables) -> DataFrame:
    per_doc = index.postings(t.documents).groupBy("doc_id").agg(F.sum("tf").alias("tokens"))
    return per_doc.join(t.documents.select("doc_id", "source"), "doc_id").select("doc_id", "source", "tokens")


@query("s3_upsert", "SELECT doc_id AS id, 'new' AS content FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, source FROM documents WHERE lang <> 'de' OR lang IS NULL")
def upsert(t: Tables) -> DataFrame:
    old = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("content"))
    new = t.documents.where("lang = 'de'").select(F.col("doc_id").alias("id"), F.lit("new").alias("content"))
    return index.ChunkIndex(old).upsert(new).rows


@query("s5_delete_batch", "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_batch(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), "source")
    return index.ChunkIndex(rows).delete(t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))).rows


@query("s13_replace_documents", "SELECT doc_id, 0 AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 1 FROM labels")
def replace(t: Tables) -> DataFrame:
    from larkspine.sources.sinks import replace_documents

    return replace_documents(t.documents.select("doc_id", F.lit(0).alias("v")), t.labels.select("doc_id", F.lit(1).alias("v")))


@query(
    "s11_enrich_metadata",
    "SELECT doc_id, k, v FROM (SELECT doc_id, unnest(['docId', 'lang', 'segmentLength', 'source']) AS k, unnest([doc_id::VARCHAR, lang, length(text)::VARCHAR, 'own']) AS v FROM documents) x",
)
def enrich(t: Tables) -> DataFrame:
    m = index.enrich(F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")), F.col("doc_id"), F.col("text"), F.create_map(F.lit("source"), F.lit("own")))
    return t.documents.select("doc_id", F.explode(m).alias("k", "v"))


@query("s16_parent_child_ids", "SELECT doc_id::VARCHAR || '_chunk_' || i::VARCHAR AS child_id, doc_id AS parent_id FROM (SELECT doc_id, unnest(range(greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS i FROM documents) x")
def child_ids(t: Tables) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1000)).cast("int")
    rows = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select(index.segment_ids(F.col("doc_id"), F.col("i"), "_chunk_").alias("child_id"), F.col("doc_id").alias("parent_id"))


# Chunkers


SLICES = "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(i * 400 + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 500) / 400.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0) x"


@query("b2_fixed_slices", SLICES)
def fixed_slices(t: Tables) -> DataFrame:
    return chunkers.exploded(t.documents, chunkers.slices(F.col("text"), 500, 100))


@query("b1_fixed_packed")
def fixed_packed(t: Tables) -> DataFrame:
    return chunkers.exploded(t.documents, chunkers.fixed(F.col("text"), 500, 50, "\n"))


@query("b4_recursive")
def recursive(t: Tables) -> DataFrame:
    return chunkers.strategy("recursive", 500, 50)(t.documents)


@query("b6_code")
def code(t: Tables) -> DataFrame:
    return chunkers.strategy("code", 500, 50)(t.documents)


@query("b7_semantic_sentences")
def semantic_sentences(t: Tables) -> DataFrame:
    return chunkers.strategy("semantic")(t.documents)


@query("b18_markdown")
def markdown(t: Tables) -> DataFrame:
    return chunkers.strategy("markdown", 500, 50)(t.documents)


@query("b22_parent_slices")
def parent_slices(t: Tables) -> DataFrame:
    return chunkers.chunked(t.documents, chunkers._Bound(chunkers.parent_slices, 800, 100))


SENTENCES = f"[{TRIM.format('s')} for s in regexp_extract_all(text, '[^。！？.!?\\n]+[。！？.!?]?') if {TRIM.format('s')} <> '']"


@query("b14_sentences", f"SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS chunk_index, unnest(s) AS chunk FROM (SELECT doc_id, {SENTENCES} AS s FROM documents) x")
def sentences(t: Tables) -> DataFrame:
    return chunkers.exploded(t.documents, chunkers.sentences(F.col("text")))


WINDOWS = f"""
    WITH s AS (SELECT doc_id, {SENTENCES} AS s FROM documents), e AS (SELECT doc_id, s, unnest(range(len(s))) AS i FROM s),
    w AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, s[i + 1] AS c, array_to_string(s[greatest(i - 2, 1):i], '') AS b, i > 0 AS hb, array_to_string(s[i + 2:i + 4], '') AS a, i + 1 < len(s) AS ha FROM e),
    x AS (SELECT doc_id, chunk_index, b || c || a AS full_window, c,
          CASE WHEN hb THEN '[BEFORE]' || b || '[BEFORE_END]' ELSE '' END || '[CENTER]' || c || '[CENTER_END]' || CASE WHEN ha THEN '[AFTER]' || a || '[AFTER_END]' ELSE '' END AS chunk FROM w)"""


@query("b15_sentence_windows", WINDOWS + " SELECT doc_id, chunk_index, chunk FROM x")
def windows(t: Tables) -> DataFrame:
    return chunkers.exploded(t.documents, chunkers.sentence_windows(F.col("text"), 3))


@query("b17_window_extract", WINDOWS + " SELECT doc_id, chunk_index, c AS center, full_window FROM x")
def window_extract(t: Tables) -> DataFrame:
    w = chunkers.exploded(t.documents, chunkers.sentence_windows(F.col("text"), 3))
    return w.select("doc_id", "chunk_index", chunkers.center_sentence(F.col("chunk")).alias("center"), chunkers.full_window(F.col("chunk")).alias("full_window"))


@query("r33_window_postprocess", WINDOWS + " SELECT doc_id, chunk_index, full_window AS text FROM x UNION ALL SELECT item_id, -1, text FROM benchmark")
def unwrap(t: Tables) -> DataFrame:
    w = chunkers.exploded(t.documents, chunkers.sentence_windows(F.col("text"), 3))
    mixed = w.unionByName(t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit(-1).alias("chunk_index"), F.col("text").alias("chunk")))
    return mixed.select("doc_id", "chunk_index", chunkers.unwrap(F.col("chunk")).alias("text"))


def semantic_rows(t: Tables) -> DataFrame:
    """Vectors as sentences of documents of 20 each."""
    e = t.embeddings
    return e.select(F.floor(F.col("vec_id") / 20).alias("doc_id"), F.col("vec_id").alias("pos"), F.concat(F.lit("s"), F.col("vec_id").cast("string"), F.lit(".")).alias("sentence"), "embedding")


DIST = f"""
    WITH r AS (SELECT vec_id // 20 AS doc_id, vec_id AS pos, 's' || vec_id::VARCHAR || '.' AS sentence, embedding FROM embeddings),
    l AS (SELECT *, lead(embedding) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM r),
    dist AS (SELECT doc_id, pos, sentence, CASE WHEN nx IS NOT NULL THEN round(1 - {cosine_sql('embedding', 'nx')}, 6) END AS distance FROM l)"""


def semantic_distances(t: Tables) -> DataFrame:
    return chunkers.distances(semantic_rows(t)).withColumn("distance", F.round("distance", 6)).select("doc_id", "pos", "sentence", "distance")


@query("b9_semantic_distance", DIST + " SELECT doc_id, pos, distance FROM dist")
def distance(t: Tables) -> DataFrame:
    return semantic_distances(t).select("doc_id", "pos", "distance")


@query("b8_context_windows", DIST + ", c AS (SELECT doc_id, pos, string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM r) SELECT * FROM c")
def contexts(t: Tables) -> DataFrame:
    return chunkers.context_windows(semantic_rows(t), 1).select("doc_id", "pos", "context")


STD = "avg(distance) + 1.5 * stddev_pop(distance)"
IQR_PARTS = "(SELECT doc_id, list_sort(list(distance)) AS s FROM dist WHERE distance IS NOT NULL GROUP BY 1)"


@query("b10_threshold_percentile", DIST + " SELECT doc_id, quantile_disc(distance, 0.95) AS threshold FROM dist WHERE distance IS NOT NULL GROUP BY 1")
def percentile(t: Tables) -> DataFrame:
    return semantic_distances(t).where("distance IS NOT NULL").groupBy("doc_id").agg(chunkers.threshold("PERCENTILE", 95).alias("threshold"))


@query("b11_threshold_std", DIST + f" SELECT doc_id, round({STD}, 6) AS threshold FROM dist WHERE distance IS NOT NULL GROUP BY 1")
def std(t: Tables) -> DataFrame:
    return semantic_distances(t).where("distance IS NOT NULL").groupBy("doc_id").agg(F.round(chunkers.threshold("STANDARD_DEVIATION", 1.5), 6).alias("threshold"))


@query("b12_threshold_iqr", DIST + f" SELECT doc_id, round(s[3 * len(s) // 4 + 1] + 1.5 * (s[3 * len(s) // 4 + 1] - s[len(s) // 4 + 1]), 6) AS threshold FROM {IQR_PARTS} x")
def iqr(t: Tables) -> DataFrame:
    return semantic_distances(t).where("distance IS NOT NULL").groupBy("doc_id").agg(F.round(chunkers.threshold("INTERQUARTILE", 1.5), 6).alias("threshold"))


@query(
    "b13_semantic_merge",
    DIST
    + """, th AS (SELECT doc_id, quantile_disc(distance, 0.8) AS threshold FROM dist WHERE distance IS NOT NULL GROUP BY 1),
    m AS (SELECT dist.*, coalesce(sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY dist.doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_index FROM dist LEFT JOIN th USING (doc_id))
    SELECT doc_id, chunk_index, string_agg(sentence, '' ORDER BY pos) AS chunk FROM m GROUP BY 1, 2""",
)
def merge(t: Tables) -> DataFrame:
    d = semantic_distances(t)
    limits = d.where("distance IS NOT NULL").groupBy("doc_id").agg(chunkers.threshold("PERCENTILE", 80).alias("threshold"))
    return chunkers.merge_at_breaks(d, limits)


# Incremental import: the registry holds documents of the first snapshot, in which every third text differed


REGISTRY = """
    WITH reg AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'docs/' ELSE 'docs2/' END || doc_id::VARCHAR AS document_id,
                        CASE WHEN doc_id % 3 = 0 THEN md5('old') ELSE md5(text) END AS content_hash,
                        CASE WHEN doc_id % 11 = 0 THEN 'DELETED' ELSE 'ACTIVE' END AS status, 1 AS version FROM documents WHERE doc_id % 5 <> 1),
    inc AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'docs/' ELSE 'docs2/' END || doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS content FROM documents WHERE doc_id % 7 <> 2),
    j AS (SELECT coalesce(i.document_id, r.document_id) AS document_id, i.document_id IS NOT NULL AS came, content, md5(content) AS new_hash, content_hash AS old_hash, status, version AS old_version FROM inc i FULL JOIN reg r ON i.document_id = r.document_id),
    p AS (SELECT document_id, CASE WHEN came AND content IS NULL THEN 'FAILED' WHEN came AND old_version IS NULL THEN 'CREATED'
            WHEN came AND (status = 'DELETED' OR new_hash IS DISTINCT FROM old_hash) THEN 'UPDATED' WHEN came THEN 'SKIPPED'
            WHEN starts_with(document_id, 'docs/') AND status <> 'DELETED' THEN 'DELETED' END AS action, coalesce(new_hash, old_hash) AS content_hash, old_version FROM j),
    pl AS (SELECT document_id, action, content_hash, CASE WHEN action IN ('CREATED', 'UPDATED') THEN coalesce(old_version, 0) + 1 ELSE old_version END AS version FROM p WHERE action IS NOT NULL)"""


def _path():
    return F.concat(F.when(F.col("doc_id") % 2 == 0, "docs/").otherwise("docs2/"), F.col("doc_id").cast("string"))


def registry_rows(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 5 <> 1").select(
        _path().alias("document_id"),
        F.when(F.col("doc_id") % 3 == 0, F.md5(F.lit("old").cast("binary"))).otherwise(F.md5("text")).alias("content_hash"),
        F.when(F.col("doc_id") % 11 == 0, "DELETED").otherwise("ACTIVE").alias("status"),
        F.lit(1).alias("version"),
        F.lit("memory").alias("storage_type"),
        F.lit(None).cast("timestamp").alias("index_time"),
        F.lit(None).cast("timestamp").alias("update_time"),
    )


def incoming_rows(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 7 <> 2").select(_path().alias("document_id"), F.when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("text")).alias("content"))


@query("i1_registry_sync", REGISTRY + " SELECT document_id, action, content_hash, version FROM pl")
def sync(t: Tables) -> DataFrame:
    return incremental.plan(registry_rows(t), incoming_rows(t), "docs")


@query("i2_sync_counters", REGISTRY + " SELECT count(*) FILTER (action <> 'DELETED') AS total, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a.lower()}" for a in ("CREATED", "UPDATED", "SKIPPED", "DELETED", "FAILED")) + " FROM pl")
def sync_counters(t: Tables) -> DataFrame:
    return incremental.counters(incremental.plan(registry_rows(t), incoming_rows(t), "docs"))


AFTER = REGISTRY + """, done AS (SELECT coalesce(r.document_id, p.document_id) AS document_id, CASE WHEN action IN ('CREATED', 'UPDATED') THEN p.content_hash ELSE r.content_hash END AS content_hash,
    CASE WHEN action IN ('CREATED', 'UPDATED') THEN 'ACTIVE' WHEN action = 'DELETED' THEN 'DELETED' ELSE r.status END AS status,
    CASE WHEN action IN ('CREATED', 'UPDATED') THEN p.version ELSE r.version END AS version FROM reg r FULL JOIN (SELECT * FROM pl WHERE action <> 'FAILED') p ON r.document_id = p.document_id)"""


@query("i3_registry_after", AFTER + " SELECT * FROM done")
def after(t: Tables) -> DataFrame:
    r = registry_rows(t)
    return incremental.apply(r, incremental.plan(r, incoming_rows(t), "docs")).select("document_id", "content_hash", "status", "version")


@query("i4_physical_delete", AFTER + " SELECT * FROM done WHERE status <> 'DELETED'")
def after_physical(t: Tables) -> DataFrame:
    r = registry_rows(t)
    return incremental.apply(r, incremental.plan(r, incoming_rows(t), "docs"), physical=True).select("document_id", "content_hash", "status", "version")


@query("i5_status_changed", REGISTRY + " SELECT r.document_id, status, version, content_hash, CASE WHEN content IS NOT NULL THEN md5(content) <> content_hash END AS changed FROM reg r LEFT JOIN inc i ON r.document_id = i.document_id")
def status(t: Tables) -> DataFrame:
    cur = incoming_rows(t).select("document_id", incremental.content_hash(F.col("content")).alias("content_hash"))
    return incremental.status(registry_rows(t), cur)


@query("i6_list_folder", REGISTRY + " SELECT document_id, version FROM reg WHERE status <> 'DELETED' AND starts_with(document_id, 'docs/')")
def folder(t: Tables) -> DataFrame:
    return incremental.active(registry_rows(t)).where(incremental.in_folder("docs") & (F.col("storage_type") == "memory")).select("document_id", "version")


@query("i7_needs_update", REGISTRY + " SELECT i.document_id, md5(content) IS DISTINCT FROM content_hash AS needs_update FROM inc i LEFT JOIN (SELECT * FROM reg WHERE status <> 'DELETED') r ON i.document_id = r.document_id")
def needs(t: Tables) -> DataFrame:
    cur = incoming_rows(t).select("document_id", incremental.content_hash(F.col("content")).alias("content_hash"))
    return incremental.needs_update(registry_rows(t), cur)


@query("i8_chunk_ids", f"SELECT doc_id::VARCHAR || '_chunk_' || chunk_index::VARCHAR || '_' || substring(md5(chunk), 1, 8) AS chunk_id, chunk FROM ({SLICES}) y")
def chunk_ids(t: Tables) -> DataFrame:
    return incremental.chunk_rows(chunkers.exploded(t.documents, chunkers.slices(F.col("text"), 500, 100))).select("chunk_id", "chunk")


@query("i9_find_by_hash", REGISTRY + " SELECT document_id, content_hash FROM reg WHERE content_hash = md5('old') ORDER BY document_id LIMIT 1")
def by_hash(t: Tables) -> DataFrame:
    import hashlib

    return incremental.by_hash(registry_rows(t), hashlib.md5(b"old").hexdigest()).select("document_id", "content_hash")


@query("i10_rebuild")
def rebuild(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("document_id", _path())
    return incremental.rebuild(registry_rows(t), docs, chunkers.strategy("recursive", 500, 50))


@query("j7_anti_delete", REGISTRY + " SELECT document_id FROM reg WHERE document_id NOT IN (SELECT document_id FROM inc)")
def anti(t: Tables) -> DataFrame:
    return registry_rows(t).join(incoming_rows(t), "document_id", "left_anti").select("document_id")


@query("a16_registry_scan", REGISTRY + " SELECT document_id, content_hash, status FROM reg WHERE status <> 'DELETED'")
def registry_scan(t: Tables) -> DataFrame:
    return incremental.active(registry_rows(t)).select("document_id", "content_hash", "status")


@query("w8_version_history", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version FROM events")
def versions(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.events.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("version"))


@query("st1_event_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(t: Tables) -> DataFrame:
    from larkspine.streaming.ingest import event_counts

    return event_counts(t.events).withColumn("total", F.round("total", 4))
