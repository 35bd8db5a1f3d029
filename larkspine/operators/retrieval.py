"""Dense and sparse retrieval for batches of queries, with ranks per query.

Scores are rounded to six digits before ranking, and ties go to the smaller id, so results do not
depend on the order in which a cluster adds numbers up.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspine.functions import models
from larkspine.functions.text import tokens_basic, tokens_mixed
from larkspine.operators import channels
from larkspine.operators.index import KeywordIndex, index_stats, postings
from larkspine.operators.topk import best_rows
from larkspine.operators.vector_index import BLOCK_BYTES

K1, B = 1.5, 0.75
#: Queries that one pass over the vectors handles; more queries take more passes.
QUERY_BLOCK = 4096


def ranked(rows: DataFrame, k: int | None, score: str = "score", by: str = "query_id", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    """1-based rank within each query, best first; ``k`` keeps the first ones."""
    out = rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))
    return out.where(F.col(rank) <= k) if k else out


def query_terms(queries: DataFrame, advanced: bool = False) -> DataFrame:
    """query_id, term, qtf of (query_id, query)."""
    tokens = tokens_mixed(F.col("query")) if advanced else tokens_basic(F.col("query"))
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def idf() -> Column:
    """A term's weight by n_docs and df."""
    return F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def saturation(tf: str, k1: float = K1, b: float = B) -> Column:
    """What a frequency counts in a document of len characters."""
    return F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))


def _best(matched: DataFrame, k: int | None, k1: float, b: float) -> DataFrame:
    """query_id, doc_id, score, rank, matched_terms of rows with query_id, term, qtf, df, doc_id, tf, len, n_docs, avgdl."""
    total = matched.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * idf() * saturation("tf", k1, b)), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched_terms"))
    return ranked(total, k)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, advanced: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score, rank, matched_terms: the best ``k`` documents by BM25 for each query (query_id, query), without an index.

    Lengths are characters.  Basic: tokenizer A, repeated query terms count repeatedly.  ``advanced``:
    tokenizer B, distinct terms, tf 1.  Postings are cut to the queries' terms where they are read.
    """
    terms = query_terms(queries, advanced)
    found = postings(docs, advanced, terms=terms)
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lengths = docs.select("doc_id", F.length("text").alias("len"))
    return _best(terms.join(df.join(F.broadcast(index_stats(docs))), "term").join(found, "term").join(lengths, "doc_id"), k, k1, b)


def keyword_search(index: KeywordIndex, queries: DataFrame, k: int | None = 10, k1: float = K1, b: float = B) -> DataFrame:
    """bm25() over a stored index: reads the postings of the queries' terms only."""
    return _best(index.matches(query_terms(queries, index.distinct)), k, k1, b)


def _top(queries: np.ndarray, ids: np.ndarray, k: int):
    def run(batches):
        best = best_rows(ids, queries, k)
        for batch in batches:
            best.add(batch.column(0).to_numpy(), batch.column(1))
        yield from best.rows()

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, min_score: float | None = None, scale: str = "cosine", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, doc_id, score, rank: exact best ``k`` of (doc_id, embedding) by cosine for each of (query_id, embedding).

    Each task multiplies its vectors with a block of queries (of one length, of ``block`` queries or ``BLOCK_BYTES`` at most) and
    returns ``k`` rows per query, so what is shuffled is tasks x queries x k.  All vectors are read for every block; an index
    (``VectorIndex``) reads a query's nearest cells.
    """
    spark = vectors.sparkSession
    table = vectors.select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<float>")).where("doc_id is not null and embedding is not null")
    held, out, size = [], None, 0
    for row in [*queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator(), None]:
        if held and (row is None or len(held) == block or size >= BLOCK_BYTES or len(row[1]) != len(held[0][1])):
            part = table.mapInArrow(_top(np.array([r[1] for r in held], float), np.array([int(r[0]) for r in held]), k), "query_id long, doc_id long, score double")
            out = part if out is None else out.unionByName(part)
            held, size = [], 0
        if row is not None:
            held.append(row)
            size += 8 * len(row[1])
    if out is None:
        out = spark.createDataFrame([], "query_id long, doc_id long, score double")
    if scale == "relevance":
        out = out.withColumn("score", F.round((F.col("score") + 1) / 2, 6))
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return ranked(out, k)


def filtered(vectors: DataFrame, queries: DataFrame, condition: Column, k: int = 5, parity: bool = False, min_score: float | None = None) -> DataFrame:
    """Dense search under a predicate on the vector table's columns: applied before ranking; with ``parity`` after
    fetching three times as many, which can return fewer than ``k``."""
    if not parity:
        return dense(vectors.where(condition), queries, k, min_score)
    found = dense(vectors, queries, 3 * k, min_score)
    rest = vectors.where(condition).select("doc_id")
    return ranked(found.drop("rank").join(rest, "doc_id", "left_semi"), k)


def multi_match(docs: DataFrame, queries: DataFrame, meta: Column, k: int = 10, boost: float = 2.0, min_score: float = 0.0) -> DataFrame:
    """Best-fields search: the larger of ``boost`` x BM25 of the text and BM25 of a metadata string."""
    body = bm25(docs, queries, None).select("query_id", "doc_id", (F.col("score") * boost).alias("score"))
    side = bm25(docs.withColumn("text", meta), queries, None).select("query_id", "doc_id", "score")
    best = body.unionByName(side).groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))
    return ranked(best.where(F.col("score") >= min_score), k)


def parents(children: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """query_id, parent_id, position: the first child of each parent in rank order, until ``k`` parents per query."""
    first = children.join(links, "child_id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("position"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "parent_id"))).where(F.col("n") <= k).drop("n")


def multi_query(hits: DataFrame, group: str = "query_group", pos: str = "query_pos", key: str = "doc_id", k: int = 10) -> DataFrame:
    """Ordered union of several queries' results: each key once, at its first place (query position, then rank)."""
    place = F.min(F.struct(pos, "rank")).alias("place")
    first = hits.groupBy(group, key).agg(place)
    order = Window.partitionBy(group).orderBy("place", key)
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(group, key, "n")



class Retriever(Protocol):
    """Whatever answers queries with (query_id, doc_id, score, rank)."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class DenseRetriever:
    """Search of (doc_id, embedding) for (query_id, query), which an embedder turns into vectors."""

    vectors: DataFrame
    embedder: models.Embedder
    min_score: float | None = None

    def __call__(self, queries: DataFrame, k: int) -> DataFrame:
        embedded = queries.select("query_id", models.embed(self.embedder, F.col("query")).alias("embedding"))
        return dense(self.vectors, embedded, k, self.min_score)


@dataclass(frozen=True)
class KeywordRetriever:
    index: KeywordIndex

    def __call__(self, queries: DataFrame, k: int) -> DataFrame:
        return keyword_search(self.index, queries, k).select("query_id", "doc_id", "score", "rank")


@dataclass(frozen=True)
class HybridRetriever:
    """Two retrievers as one; a channel that can't be planned, because its store is missing or broken, counts as empty.

    With a time limit, and a folder that driver and executors share, the channels run when the retriever is called, at once, and one that fails or
    stalls while it runs counts as empty too.  Without, both are parts of the plan that is returned.
    """

    dense: Retriever
    sparse: Retriever
    strategy: str = "RRF"
    fetch: int = 20
    timeout_s: float | None = None
    folder: str | None = None

    def __call__(self, queries: DataFrame, k: int) -> DataFrame:
        from larkspine.operators.fusion import fuse

        if self.timeout_s is None:
            found = [channel(self.__dict__[name], queries, self.fetch) for name in ("dense", "sparse")]
        else:
            found = [o.hits for o in self.outcomes(queries).values()]
        return fuse(self.strategy, *found, k).select("query_id", "doc_id", "score", F.col("final_rank").alias("rank"))


    def outcomes(self, queries: DataFrame) -> dict[str, channels.Outcome]:
        """What each channel found when it ran by itself, or why it found nothing."""
        if not self.folder:
            raise ValueError("a time limit needs a folder for the channels' results")
        searches = {name: (lambda name=name: self.__dict__[name](queries, self.fetch)) for name in ("dense", "sparse")}
        return channels.run(queries.sparkSession, searches, self.folder, self.timeout_s)


def channel(retriever: Retriever, queries: DataFrame, k: int) -> DataFrame:
    """A retriever's results; none, and a line in the log, where it fails before the job runs."""
    from pyspark.errors import PySparkException

    try:
        return retriever(queries, k).select("query_id", "doc_id", "score", "rank")
    except (PySparkException, OSError, ConnectionError, TimeoutError) as e:
        channels.log.warning("a channel could not be planned: %s", str(e).split("\n")[0])
        return queries.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")


def multi_query_reranked(search: Retriever, queries: DataFrame, texts: DataFrame, answer, k: int = 10) -> DataFrame:
    """query_group, doc_id, score, rank: the union of 2k results of each of a group's queries (query_group, query_pos, query_id, query),
    one of each text, rated against the group's first query."""
    from larkspine.operators.rerank import rerank

    hits = search(queries.select("query_id", "query"), 2 * k).join(queries.select("query_group", "query_pos", "query_id"), "query_id").join(texts, "doc_id")
    once = hits.groupBy("query_group", "text").agg(F.min(F.struct("query_pos", "rank", "doc_id")).alias("place")).select("query_group", "text", "place.doc_id")
    first = queries.groupBy("query_group").agg(F.min_by("query", "query_pos").alias("query"))
    rated = rerank(once.join(first, "query_group").withColumnRenamed("query_group", "query_id"), answer, k)
    return rated.select(F.col("query_id").alias("query_group"), "doc_id", "score", "rank")
