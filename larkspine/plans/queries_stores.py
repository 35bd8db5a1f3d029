"""Stores that are searched by an index, or that take changes: approximate vector search, keyword generations."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspine.functions import session, text
from larkspine.operators import field_search, filters, index, metadata_table, paths, pruned_search, retrieval, vector_index
from larkspine.plans.base import Tables, query, shared_folder, tok_a
from larkspine.plans.queries_retrieval import bm25_sql, cosine_sql, dense_sql, text_queries, vector_queries, vectors


_OWN: list[tuple] = []


def _remove() -> None:
    for spark, path in _OWN:
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            paths.delete(spark, path)


def place(t: Tables, name: str) -> str:
    """A new folder for a query's index, which is removed when the driver's Python ends."""
    if not _OWN:
        atexit.register(_remove)
    _OWN.append((t.spark, f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"))
    return _OWN[-1][1]


# Approximate vector search: with the means of the labels as centroids, what the cells hold can be said in SQL.

CELLS = f"""
    dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
    c AS (SELECT label AS cell, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM dims GROUP BY 1, 2) y GROUP BY 1),
    near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {cosine_sql('embedding', 'centroid')} DESC, cell) AS place FROM embeddings, c)"""


def label_cells(t: Tables) -> vector_index.VectorIndex:
    means = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(F.col("label").cast("int").alias("cell"), F.col("c.m").alias("centroid"))
    return index.ChunkIndex(vectors(t), "doc_id").write_vectors(place(t, "vectors"), centroids=centroids)


@query(
    "s4_ivf_cells",
    "WITH " + CELLS + f""",
    ds AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({cosine_sql('a.embedding', 'b.embedding')}, 6) AS score
           FROM embeddings a JOIN near p ON p.vec_id = a.vec_id AND p.place <= 2 JOIN near o ON o.cell = p.cell AND o.place = 1 JOIN embeddings b ON b.vec_id = o.vec_id
           WHERE a.vec_id % 100 = 0)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM ds QUALIFY rank <= 10""",
)
def ivf_cells(t: Tables) -> DataFrame:
    return label_cells(t).search(vector_queries(t), 10, probes=2)


@query("s4_ivf_all_cells", "WITH " + dense_sql(10) + " SELECT * FROM dense")
def ivf_all(t: Tables) -> DataFrame:
    found = vector_index.VectorIndex(t.spark, place(t, "vectors")).create(vectors(t), 16)
    return found.search(vector_queries(t), 10, probes=16)


@query("r3_ivf_filtered", "WITH " + dense_sql(5, rows="b.label < 4") + " SELECT query_id, doc_id, score, rank FROM dense WHERE score >= 0.1")
def ivf_filtered(t: Tables) -> DataFrame:
    chunks = index.ChunkIndex(vectors(t), "doc_id")
    return chunks.search(vector_queries(t), 5, F.col("label") < 4, 0.1, chunks.write_vectors(place(t, "vectors"), 16), 16)


# A keyword index that takes changes: some documents come late, some with another text, some go.


def changed_index(t: Tables) -> index.KeywordIndex:
    docs = t.documents.select("doc_id", "text")
    first = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old "), F.reverse("text"))).otherwise(F.col("text")).alias("text"))
    found = index.KeywordIndex(t.spark, place(t, "changed")).create(first)
    found.index_batch(docs.where("doc_id % 3 = 0 OR doc_id % 5 = 0"))
    return found.delete_batch(docs.where("doc_id % 7 = 0").select("doc_id"))


_LEFT = "(SELECT * FROM documents WHERE doc_id % 7 <> 0)"


@query("s6_changed_postings", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok_a('text')}) AS term FROM {_LEFT} d) x GROUP BY 1, 2")
def changed_postings(t: Tables) -> DataFrame:
    return changed_index(t).postings()


@query("s7_changed_topk", "WITH live AS " + _LEFT + ", " + bm25_sql(10).replace("FROM documents", "FROM live").replace("JOIN documents", "JOIN live") + " SELECT query_id, doc_id, score, rank FROM bm25")
def changed_topk(t: Tables) -> DataFrame:
    return retrieval.keyword_search(changed_index(t), text_queries(t), 10).select("query_id", "doc_id", "score", "rank")


@query("s6_merged_stats", f"SELECT count(*) AS n_docs, avg(length(text)) AS avgdl, (SELECT count(DISTINCT term) FROM (SELECT unnest({tok_a('text')}) AS term FROM {_LEFT} e) x) AS vocabulary FROM {_LEFT} d")
def merged_stats(t: Tables) -> DataFrame:
    return changed_index(t).merged(place(t, "merged")).stats()


# Channels that fail while they run, and table functions


_SPARSE_ONLY = "WITH " + bm25_sql(20) + ", j AS (SELECT query_id, doc_id, 0.3 / (60 + rank) AS s FROM bm25) SELECT query_id, doc_id, round(s, 8) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, doc_id) AS INTEGER) AS rank FROM j QUALIFY rank <= 10"


@query("r22_channel_fails_in_tasks", _SPARSE_ONLY)
def fails_in_tasks(t: Tables) -> DataFrame:
    def broken(batches):
        raise ConnectionError("the store is gone")

    bad = lambda queries, k: t.embeddings.select("vec_id").mapInArrow(broken, "query_id long, doc_id long, score double, rank int")
    both = retrieval.HybridRetriever(bad, retrieval.KeywordRetriever(t.keywords()), timeout_s=600, folder=place(t, "hybrid"))
    return both(text_queries(t), 10)


@query("u16_chunk_table_slices", "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(i * 400 + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 500) / 400.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0) x")
def chunk_table(t: Tables) -> DataFrame:
    session.register(t.spark)
    return t.spark.sql("SELECT * FROM chunk_texts(TABLE(SELECT doc_id, text FROM {docs}), 'slices', 500, 100)", docs=t.documents)


# Metadata predicates that reach the scan


@query("f7_promoted_keys", "SELECT doc_id FROM documents WHERE (lang IN ('de', 'fr') AND source LIKE 'src1%') OR (source = 'src2' AND NOT (lang IS NOT DISTINCT FROM 'en'))")
def promoted_keys(t: Tables) -> DataFrame:
    m = filters.MetadataFilter
    rows = t.documents.select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string")).alias("metadata"))
    table = metadata_table.MetadataTable(t.spark, place(t, "metadata")).create(rows)
    one = filters.combine("AND", m.isin("lang", ["de", "fr"]), m().add("source", "STARTS_WITH", "src1"))
    two = filters.combine("AND", m.eq("source", "src2"), m.ne("lang", "en"))
    return table.where(filters.combine("OR", one, two)).select("doc_id")


@query("f6_promoted_numbers", "SELECT doc_id FROM documents WHERE n_chars > 2000")
def promoted_numbers(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string")).alias("metadata"))
    table = metadata_table.MetadataTable(t.spark, place(t, "metadata")).create(rows)
    return table.where(filters.MetadataFilter().add("n_chars", "GREATER_THAN", "2000")).select("doc_id")


# A chunk table that takes changes bucket by bucket


@query("s3_upsert_buckets", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'new ' || text ELSE text END AS content FROM documents WHERE doc_id % 11 <> 5 OR doc_id % 2 = 0")
def upsert_buckets(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    stored = index.ChunkIndex(rows.where("id % 3 <> 0 OR id % 2 <> 0")).write_buckets(place(t, "chunks"), 16)
    stored.delete(rows.where("id % 11 = 5").select("id"))
    stored.upsert(rows.where("id % 2 = 0").withColumn("content", F.concat(F.lit("new "), F.col("content"))))
    return stored.index().rows


# Fields, phrases, and fragments of hits


@query(
    "r9_field_index",
    "WITH meta AS (SELECT doc_id, concat_ws(' ', source, lang) AS text FROM documents), a AS (WITH "
    + bm25_sql(None)
    + " SELECT query_id, doc_id, round(score * 2.0, 6) AS score, 'text' AS field FROM bm25), b AS (WITH "
    + bm25_sql(None).replace("documents", "meta")
    + """ SELECT query_id, doc_id, score, 'meta' AS field FROM bm25), c AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, field) = 1)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10""",
)
def field_index(t: Tables) -> DataFrame:
    fields = field_search.FieldIndex(t.spark, place(t, "fields"), {"text": 2.0, "meta": 1.0})
    fields.create(t.documents.select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("meta")))
    return fields.search(text_queries(t), 10).select("query_id", "doc_id", "score", "field", "rank")


@query(
    "r6_phrases",
    f"""WITH d AS (SELECT doc_id, length(text) AS n, {tok_a('text')} AS w FROM documents),
    q AS (SELECT doc_id AS query_id, w[4:6] AS p FROM d WHERE doc_id % 100 = 0 AND len(w) >= 6),
    g AS (SELECT doc_id, n, w[i:i + 2] AS p FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - 1)) AS i FROM d) x),
    f AS (SELECT query_id, doc_id, n, count(*) AS freq FROM g JOIN q USING (p) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM d) x GROUP BY 1),
    st AS (SELECT count(*) AS n_docs, avg(n) AS avgdl FROM d),
    wt AS (SELECT query_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5))) AS weight FROM (SELECT query_id, unnest(p) AS term FROM q) x JOIN df USING (term), st GROUP BY 1),
    s AS (SELECT query_id, doc_id, freq, round(weight * freq * 2.5 / (freq + 1.5 * (0.25 + 0.75 * n / avgdl)), 6) AS score FROM f JOIN wt USING (query_id), st)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
)
def phrases(t: Tables) -> DataFrame:
    found = index.KeywordIndex(t.spark, place(t, "phrases"), positions=True).create(t.documents)
    words = text.tokens_basic(F.col("text"))
    queries = t.documents.where("doc_id % 100 = 0").where(F.size(words) >= 6).select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 4, 3), " ").alias("query"))
    return field_search.phrase_search(found, queries, 10)


_PARTS = "[A-Za-z0-9_]+|[^A-Za-z0-9_]+"


@query(
    "r10_hit_fragments",
    "WITH " + bm25_sql(10) + f""",
    f AS (SELECT query_id, doc_id, rank, matched_terms, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i
          FROM (SELECT b.*, regexp_extract_all(text, '(?s).{{1,100}}[A-Za-z0-9_]*') AS pieces FROM bm25 b JOIN documents d USING (doc_id)) x),
    h AS (SELECT *, [lower(y) for y in regexp_extract_all(piece, '{_PARTS}') if list_contains(matched_terms, lower(y))] AS hits FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY len(list_distinct(hits)) DESC, len(hits) DESC, i) AS n FROM h WHERE len(hits) > 0)
    SELECT query_id, doc_id, rank, list(array_to_string([CASE WHEN list_contains(matched_terms, lower(y)) THEN '<em>' || y || '</em>' ELSE y END for y in regexp_extract_all(piece, '{_PARTS}')], '') ORDER BY n) AS fragments
    FROM n WHERE n <= 3 GROUP BY 1, 2, 3""",
)
def hit_fragments(t: Tables) -> DataFrame:
    hits = retrieval.keyword_search(t.keywords(), text_queries(t), 10)
    return field_search.with_fragments(hits, t.documents).select("query_id", "doc_id", "rank", "fragments")


# Search by candidates


@query("r6_pruned_topk", "WITH " + bm25_sql(10) + " SELECT query_id, doc_id, score, rank, matched_terms FROM bm25")
def pruned_topk(t: Tables) -> DataFrame:
    return pruned_search.pruned_search(t.keywords(), text_queries(t), 10, place(t, "pruned")).select("query_id", "doc_id", "score", "rank", "matched_terms")


@query("r7_pruned_topk", "WITH " + bm25_sql(10, True) + " SELECT query_id, doc_id, score, rank, matched_terms FROM bm25")
def pruned_topk_advanced(t: Tables) -> DataFrame:
    return pruned_search.pruned_search(t.keywords(True), text_queries(t), 10, place(t, "pruned")).select("query_id", "doc_id", "score", "rank", "matched_terms")
