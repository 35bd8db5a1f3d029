"""Retrieval, fusion, joins, windows and rankings as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspine.functions.text import jaccard, word_set
from larkspine.operators import fusion, index, rerank, retrieval
from larkspine.plans import base
from larkspine.plans.base import Tables, query, tok_a, tok_b

TEXT_QUERIES = "SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 100 = 0"


def text_queries(t: Tables) -> DataFrame:
    return t.benchmark.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def sparse(t: Tables, k: int = 20) -> DataFrame:
    return retrieval.keyword_search(t.keywords(), text_queries(t), k).select("query_id", "doc_id", "score", "rank")


def dense(t: Tables, k: int = 20) -> DataFrame:
    q = vector_queries(t).join(text_queries(t).select("query_id"), "query_id")
    return retrieval.dense(vectors(t), q, k)


def bm25_sql(k: int | None, advanced: bool = False) -> str:
    """CTEs that end with ``bm25`` (query_id, doc_id, score, matched_terms, rank)."""
    tok = tok_b if advanced else tok_a
    tf = "1" if advanced else "count(*)"
    limit = f"QUALIFY rank <= {k}" if k else ""
    return f"""
        q AS ({TEXT_QUERIES}),
        qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok('query')}) AS term FROM q) x GROUP BY 1, 2),
        p AS (SELECT doc_id, term, {tf} AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) x GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        st AS (SELECT count(*) AS n_docs, avg(length(text)) AS avgdl FROM documents),
        s AS (SELECT qt.query_id, p.doc_id, list_sort(list(DISTINCT qt.term)) AS matched_terms,
                     round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length(text) / avgdl))), 6) AS score
              FROM qt JOIN df USING (term) JOIN p USING (term) JOIN documents d ON d.doc_id = p.doc_id, st GROUP BY 1, 2),
        bm25 AS (SELECT query_id, doc_id, score, matched_terms, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s {limit})"""


def cosine_sql(a: str, b: str) -> str:
    d = lambda x, y: f"list_sum([z[1]::DOUBLE * z[2]::DOUBLE for z in list_zip({x}, {y})])"
    return f"{d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)}))"


def dense_sql(k: int | None, queries: str = "vec_id % 100 = 0", rows: str = "true") -> str:
    """CTEs that end with ``dense`` (query_id, doc_id, score, rank)."""
    limit = f"QUALIFY rank <= {k}" if k else ""
    return f"""
        ds AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({cosine_sql('a.embedding', 'b.embedding')}, 6) AS score
               FROM embeddings a, embeddings b WHERE a.{queries} AND {rows}),
        dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM ds {limit})"""


BOTH_SQL = (
    "WITH "
    + bm25_sql(20)
    + ","
    + dense_sql(None)
    + """,
        d AS (SELECT dense.* FROM dense JOIN q USING (query_id) WHERE rank <= 20),
        j AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id,
                     d.score AS dense_score, d.rank AS dense_rank, s.score AS sparse_score, s.rank AS sparse_rank
              FROM d FULL JOIN (SELECT query_id, doc_id, score, rank FROM bm25) s ON d.query_id = s.query_id AND d.doc_id = s.doc_id)"""
)


def top_sql(score: str, k: int = 10, cols: str = "query_id, doc_id, dense_rank, sparse_rank", rank: str = "final_rank", of: str = "j") -> str:
    return f"""
        SELECT {cols}, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS {rank}
        FROM (SELECT *, round({score}, 8) AS score FROM {of}) z QUALIFY {rank} <= {k}"""


@query("r6_bm25_topk", "WITH " + bm25_sql(10) + " SELECT query_id, doc_id, score, rank, matched_terms FROM bm25")
def bm25_topk(t: Tables) -> DataFrame:
    return retrieval.keyword_search(t.keywords(), text_queries(t), 10).select("query_id", "doc_id", "score", "rank", "matched_terms")


@query("r7_bm25_advanced_topk", "WITH " + bm25_sql(10, True) + " SELECT query_id, doc_id, score, rank, matched_terms FROM bm25")
def bm25_advanced(t: Tables) -> DataFrame:
    return retrieval.keyword_search(t.keywords(True), text_queries(t), 10).select("query_id", "doc_id", "score", "rank", "matched_terms")


REPEATED = TEXT_QUERIES.replace("text AS query", "text || ' ' || text AS query")


@query("r8_bm25_repeated_terms", "WITH " + bm25_sql(10).replace(TEXT_QUERIES, REPEATED) + " SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_repeated(t: Tables) -> DataFrame:
    q = text_queries(t).withColumn("query", F.concat_ws(" ", "query", "query"))
    return retrieval.keyword_search(t.keywords(), q, 10).select("query_id", "doc_id", "score", "rank")


@query("r1_dense_topk", "WITH " + dense_sql(10) + " SELECT query_id, doc_id, score, rank FROM dense")
def dense_topk(t: Tables) -> DataFrame:
    return retrieval.dense(vectors(t), vector_queries(t), 10)


@query("r2_cosine", f"SELECT vec_id, round({cosine_sql('embedding', 'q')}, 6) AS cosine FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) x")
def cosine(t: Tables) -> DataFrame:
    from larkspine.functions.vector import cosine as cos

    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q)).select("vec_id", F.round(cos(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("r3_dense_filtered", "WITH " + dense_sql(10, rows="b.label = 1") + " SELECT query_id, doc_id, score, rank FROM dense")
def dense_filtered(t: Tables) -> DataFrame:
    return retrieval.filtered(vectors(t), vector_queries(t), F.col("label") == 1, 10)


@query("f17_min_score", "WITH " + dense_sql(None) + " SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, round((score + 1) / 2, 6) AS score, rank FROM dense) x WHERE score >= 0.7 AND rank <= 5")
def min_score(t: Tables) -> DataFrame:
    return retrieval.dense(vectors(t), vector_queries(t), 5, min_score=0.7, scale="relevance").select("query_id", "doc_id", "score")


@query(
    "f18_post_filter_3x",
    "WITH " + dense_sql(30) + ", f AS (SELECT query_id, doc_id, score FROM dense JOIN embeddings e ON e.vec_id = doc_id WHERE label = 1) SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10",
)
def post_filter(t: Tables) -> DataFrame:
    return retrieval.filtered(vectors(t), vector_queries(t), F.col("label") == 1, 10, parity=True).select("query_id", "doc_id", "score", "rank")


@query("r29_batch_topk", "WITH " + bm25_sql(5) + " SELECT query_id, doc_id, rank FROM bm25")
def batch(t: Tables) -> DataFrame:
    return sparse(t, 5).select("query_id", "doc_id", "rank")


@query("r31_search", "WITH " + dense_sql(5) + " SELECT query_id, doc_id, score FROM dense")
def plain(t: Tables) -> DataFrame:
    return retrieval.dense(vectors(t), vector_queries(t), 5).select("query_id", "doc_id", "score")


@query("r9_multi_match")
def multi(t: Tables) -> DataFrame:
    return retrieval.multi_match(t.documents, text_queries(t), F.concat_ws(" ", "source", "lang"), 10)


WEIGHTED = "coalesce(0.7 / (60 + dense_rank), 0.0) + coalesce(0.3 / (60 + sparse_rank), 0.0)"


@query("r12_rrf_basic", BOTH_SQL + top_sql(WEIGHTED))
def rrf_basic(t: Tables) -> DataFrame:
    return fusion.rrf(dense(t), sparse(t)).select("query_id", "doc_id", "dense_rank", "sparse_rank", "score", "final_rank")


@query("r13_rrf_missing_rank", BOTH_SQL + top_sql("0.7 / (60 + coalesce(dense_rank, 999)) + 0.3 / (60 + coalesce(sparse_rank, 999))"))
def rrf_missing(t: Tables) -> DataFrame:
    return fusion.rrf(dense(t), sparse(t), missing_rank=fusion.MISSING).select("query_id", "doc_id", "dense_rank", "sparse_rank", "score", "final_rank")


@query("r14_rrf_with_source", "SELECT z.*, source, lang FROM (" + BOTH_SQL + top_sql(WEIGHTED, cols="query_id, doc_id") + ") z LEFT JOIN documents USING (doc_id)")
def rrf_production(t: Tables) -> DataFrame:
    fused = fusion.rrf(dense(t), sparse(t)).select("query_id", "doc_id", "score", "final_rank")
    return fused.join(t.documents.select("doc_id", "source", "lang"), "doc_id", "left")


@query(
    "r15_rrf_ensemble",
    BOTH_SQL
    + """, u AS (SELECT query_id, doc_id, rank, 'dense' AS c FROM d UNION ALL SELECT query_id, doc_id, rank, 'sparse' FROM bm25),
        g AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS total, string_agg(c, '+' ORDER BY c) AS sources FROM u GROUP BY 1, 2)"""
    + top_sql("total", cols="query_id, doc_id, sources", rank="rank", of="g"),
)
def rrf_ensemble(t: Tables) -> DataFrame:
    return fusion.ensemble({"dense": dense(t), "sparse": sparse(t)}).select("query_id", "doc_id", "sources", "score", "rank")


def _normal(flat: str) -> str:
    return f"round(CASE WHEN max(score) OVER w = min(score) OVER w THEN {flat} ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6)"


for _name, _flat in (("r16_minmax_zero", 0.0), ("r17_minmax_one", 1.0)):

    @query(_name, "WITH " + bm25_sql(20) + f", m AS (SELECT * FROM bm25 UNION ALL SELECT query_id + 1, doc_id, score, matched_terms, rank FROM bm25 WHERE rank = 1) SELECT query_id, doc_id, {_normal(str(_flat))} AS score FROM m WINDOW w AS (PARTITION BY query_id)")
    def minmax(t: Tables, flat: float = _flat) -> DataFrame:
        s = sparse(t)
        alone = s.where("rank = 1").withColumn("query_id", F.col("query_id") + 1)
        return fusion.min_max(s.unionByName(alone), flat).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    "r18_weighted_sum",
    BOTH_SQL
    + """, n AS (SELECT *, CASE WHEN max(dense_score) OVER w = min(dense_score) OVER w THEN 0.0 ELSE (dense_score - min(dense_score) OVER w) / (max(dense_score) OVER w - min(dense_score) OVER w) END AS dn,
                 CASE WHEN max(sparse_score) OVER w = min(sparse_score) OVER w THEN 0.0 ELSE (sparse_score - min(sparse_score) OVER w) / (max(sparse_score) OVER w - min(sparse_score) OVER w) END AS sn FROM j WINDOW w AS (PARTITION BY query_id))"""
    + top_sql("0.7 * CASE WHEN dense_score IS NULL THEN 0 ELSE dn END + 0.3 * CASE WHEN sparse_score IS NULL THEN 0 ELSE sn END", of="n"),
)
def weighted(t: Tables) -> DataFrame:
    return fusion.weighted(dense(t), sparse(t)).select("query_id", "doc_id", "dense_rank", "sparse_rank", "score", "final_rank")


COUNTS = "count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NULL) AS dense_only, count(*) FILTER (dense_rank IS NULL) AS sparse_only, count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS both_channels, count(*) AS total"


@query("r19_channel_attribution", f"SELECT query_id, {COUNTS}, format('{{}} results: {{}} dense only, {{}} sparse only, {{}} both', total, dense_only, sparse_only, both_channels) AS analysis FROM (" + BOTH_SQL + top_sql(WEIGHTED) + ") z GROUP BY query_id")
def attribution(t: Tables) -> DataFrame:
    return fusion.explanation(fusion.rrf(dense(t), sparse(t))).select("query_id", "dense_only", "sparse_only", F.col("both").alias("both_channels"), "total", "analysis")


@query(
    "r20_compare",
    "SELECT query_id, z.doc_id, final_rank, CASE WHEN dense_rank IS NOT NULL AND sparse_rank IS NOT NULL THEN 'both' WHEN dense_rank IS NOT NULL THEN 'dense_only' ELSE 'sparse_only' END AS channel, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview FROM ("
    + BOTH_SQL
    + top_sql(WEIGHTED)
    + ") z JOIN documents USING (doc_id)",
)
def compare(t: Tables) -> DataFrame:
    return fusion.compare(fusion.rrf(dense(t), sparse(t)), t.documents)


@query("r21_index_stats", f"SELECT count(*) AS n_docs, round(avg(length(text)), 6) AS avgdl, (SELECT count(DISTINCT term) FROM (SELECT unnest({tok_a('text')}) AS term FROM documents) x) AS vocabulary, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b FROM documents")
def stats(t: Tables) -> DataFrame:
    return t.keywords().stats().select("n_docs", F.round("avgdl", 6).alias("avgdl"), "vocabulary", F.lit(1.5).alias("k1"), F.lit(0.75).alias("b"))


def base_tokens(c: str):
    from larkspine.functions.text import tokens_basic

    return tokens_basic(F.col(c))


JACCARD = f"round(len(list_intersect({base.word_set('d.text')}, {base.word_set('q.query')})) / len(list_distinct(list_concat({base.word_set('d.text')}, {base.word_set('q.query')}))), 6)"


@query("r26_jaccard", "WITH " + bm25_sql(20) + f" SELECT b.query_id, b.doc_id, {JACCARD} AS jaccard FROM bm25 b JOIN q ON b.query_id = q.query_id JOIN documents d ON d.doc_id = b.doc_id")
def jaccard_pairs(t: Tables) -> DataFrame:
    hits = sparse(t).join(text_queries(t), "query_id").join(t.documents.select("doc_id", "text"), "doc_id")
    return hits.select("query_id", "doc_id", F.round(jaccard(word_set(F.col("text")), word_set(F.col("query"))), 6).alias("jaccard"))


def hits_with_text(t: Tables, k: int = 20) -> DataFrame:
    return sparse(t, k).join(t.documents.select("doc_id", "text"), "doc_id")


@query("r25_mmr_diverse")
def mmr(t: Tables) -> DataFrame:
    return rerank.mmr(hits_with_text(t), 10, 0.5)


@query("r30_diverse_search")
def diverse(t: Tables) -> DataFrame:
    return rerank.diverse(hits_with_text(t), 5, 0.3)


@query("f22_rerank_cut", "WITH " + bm25_sql(20) + " SELECT query_id, doc_id, score FROM bm25 WHERE score >= 5.0")
def rerank_cut(t: Tables) -> DataFrame:
    return rerank.cut(sparse(t)).select("query_id", "doc_id", "score")


@query("r23_rerank_passthrough", "WITH " + bm25_sql(20) + ", r AS (SELECT query_id, doc_id, 1.0::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INTEGER) AS rank FROM bm25) SELECT * FROM r WHERE rank <= 5")
def rerank_off(t: Tables) -> DataFrame:
    return rerank.rerank(sparse(t).drop("rank"), None, 5).select("query_id", "doc_id", "score", "rank")


@query("r27_enhanced_search")
def enhanced(t: Tables) -> DataFrame:
    texts, queries = t.documents.select("doc_id", "text"), text_queries(t)
    found = lambda k: sparse(t, k).join(texts, "doc_id").join(queries, "query_id")
    rate = lambda q, d: F.format_string("score: %.4f", 10 * jaccard(word_set(q), word_set(d)))
    return rerank.enhanced(found, 5, rate, 0.1).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(
    "r28_multi_query",
    "WITH " + bm25_sql(20) + ", f AS (SELECT doc_id, min((query_id // 100) * 1000 + rank) AS place FROM bm25 GROUP BY 1) SELECT 0 AS query_group, doc_id, CAST(row_number() OVER (ORDER BY place, doc_id) AS INTEGER) AS n FROM f QUALIFY n <= 10",
)
def multi_query(t: Tables) -> DataFrame:
    hits = sparse(t).withColumn("query_group", F.lit(0)).withColumn("query_pos", F.col("query_id") / 100)
    return retrieval.multi_query(hits)


PARENTS = """WITH c AS (SELECT vec_id AS child_id, vec_id // 5 AS parent_id FROM embeddings), {dense}
    , f AS (SELECT query_id, parent_id, min(rank) AS position FROM dense JOIN c ON c.child_id = dense.doc_id GROUP BY 1, 2)
    SELECT query_id, parent_id, position FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position, parent_id) <= 5"""


@query("r32_parent_lookup", PARENTS.format(dense=dense_sql(20)))
def parent_lookup(t: Tables) -> DataFrame:
    links = t.embeddings.select(F.col("vec_id").alias("child_id"), F.floor(F.col("vec_id") / 5).alias("parent_id"))
    hits = retrieval.dense(vectors(t), vector_queries(t), 20).withColumnRenamed("doc_id", "child_id")
    return retrieval.parents(hits, links, 5)


@query("j1_term_lookup", f"WITH q AS ({TEXT_QUERIES}), qt AS (SELECT DISTINCT unnest({tok_a('query')}) AS term FROM q) SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok_a('text')}) AS term FROM documents) x WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2")
def term_lookup(t: Tables) -> DataFrame:
    terms = text_queries(t).select(F.explode(base_tokens("query")).alias("term"))
    return index.postings(t.documents, terms=terms)


@query("j3_dense_sparse_outer", BOTH_SQL + " SELECT query_id, doc_id, dense_rank, sparse_rank FROM j")
def outer(t: Tables) -> DataFrame:
    return fusion.both(dense(t), sparse(t)).select("query_id", "doc_id", "dense_rank", "sparse_rank")


@query("j8_knowledge_scan", "WITH " + dense_sql(3) + " SELECT query_id, doc_id AS item_id, score FROM dense")
def knowledge(t: Tables) -> DataFrame:
    return retrieval.dense(vectors(t), vector_queries(t), 3).select("query_id", F.col("doc_id").alias("item_id"), "score")


@query("w6_final_rank_by_label", "SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS INTEGER) AS n FROM embeddings")
def final_rank(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id"))).alias("n"))


@query("u1_ordered_union", "WITH " + bm25_sql(20) + ", f AS (SELECT doc_id, min(query_id * 1000 + rank) AS place FROM bm25 GROUP BY 1) SELECT doc_id, place FROM f")
def ordered_union(t: Tables) -> DataFrame:
    return sparse(t).groupBy("doc_id").agg(F.min(F.col("query_id") * 1000 + F.col("rank")).alias("place"))


@query("u2_key_union", BOTH_SQL + " SELECT query_id, doc_id FROM d UNION SELECT query_id, doc_id FROM bm25")
def key_union(t: Tables) -> DataFrame:
    return dense(t).select("query_id", "doc_id").union(sparse(t).select("query_id", "doc_id")).distinct()
