"""Reranking: scores of a model, greedy diversity, and searches that combine them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspine.functions.parsers import rating
from larkspine.functions.text import truncate
from larkspine.operators.retrieval import ranked

CUT = 5.0


def rerank(hits: DataFrame, answer: Callable[[Column, Column], Column] | None, k: int, strict_parity: bool = False) -> DataFrame:
    """Rates (query, text cut to 500) of every hit by a model's answer; without a model every score is 1; an answer that is missing counts 5."""
    if answer is None:
        return ranked(hits.withColumn("score", F.lit(1.0)), k)
    rated = F.coalesce(rating(answer(F.col("query"), truncate(F.col("text"), 500)), strict_parity), F.lit(5.0))
    return ranked(hits.withColumn("score", rated), k)


def cut(hits: DataFrame, least: float = CUT) -> DataFrame:
    return hits.where(F.col("score") >= least)


def mmr_order(scores: list[float], texts: list[str], k: int, lam: float) -> list[int]:
    """Greedy maximal marginal relevance: lam * score / 10 - (1 - lam) * largest Jaccard to what is chosen; ties to the first."""
    sets = [set((t or "").lower().split()) for t in texts]
    near = [0.0] * len(texts)
    left, chosen = list(range(len(texts))), []
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (lam * scores[i] / 10 - (1 - lam) * near[i], -i))
        chosen.append(best)
        left.remove(best)
        for i in left:
            union = len(sets[i] | sets[best])
            near[i] = max(near[i], len(sets[i] & sets[best]) / union if union else 0.0)
    return chosen


def mmr(hits: DataFrame, k: int = 10, lam: float = 0.5) -> DataFrame:
    """query_id, doc_id, score, mmr_rank of each query's hits (already the best 2k, so a group is bounded)."""

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["score"], r["doc_id"]))
        order = mmr_order([r["score"] for r in rows], [r["text"] for r in rows], k, lam)
        return pa.table({"query_id": [rows[i]["query_id"] for i in order], "doc_id": [rows[i]["doc_id"] for i in order], "score": [rows[i]["score"] for i in order], "mmr_rank": pa.array(range(1, len(order) + 1), pa.int32())})

    best = ranked(hits, 2 * k).select(F.col("query_id").cast("long"), F.col("doc_id").cast("long"), F.col("score").cast("double"), "text")
    return best.groupBy("query_id").applyInArrow(one, "query_id long, doc_id long, score double, mmr_rank int")


def diverse(hits: DataFrame, k: int, diversity: float) -> DataFrame:
    """MMR with lambda = 1 - diversity; the hits of a query that has no more than ``k`` stay as they are, in order of score."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = hits.join(n, "query_id")
    few = ranked(sized.where(F.col("_n") <= k).drop("rank"), None, rank="mmr_rank").select(F.col("query_id").cast("long"), F.col("doc_id").cast("long"), F.col("score").cast("double"), "mmr_rank")
    return mmr(sized.where(F.col("_n") > k).drop("_n"), k, 1 - diversity).unionByName(few)


def enhanced(search: Callable[[int], DataFrame], k: int, answer: Callable[[Column, Column], Column] | None, least: float = CUT) -> DataFrame:
    """Fetches k, or 2k to rerank them and cut at ``least``."""
    if answer is None:
        return search(k)
    return cut(rerank(search(2 * k).drop("rank"), answer, k), least)
