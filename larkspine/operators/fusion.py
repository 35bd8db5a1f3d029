"""Fusing channels of ranked results (query_id, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspine.operators.retrieval import ranked

RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT, MISSING = 60, 0.7, 0.3, 999


def dedupe(channel: DataFrame, key: str = "doc_id") -> DataFrame:
    """The best rank of each key."""
    w = Window.partitionBy("query_id", key).orderBy("rank")
    return channel.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Full outer join of two channels: dense_score, dense_rank, sparse_score, sparse_rank."""
    d = dedupe(dense).select("query_id", "doc_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = dedupe(sparse).select("query_id", "doc_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    return d.join(s, ["query_id", "doc_id"], "full_outer")


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 10, missing_rank: int | None = None, weights: tuple[float, float] = (DENSE_WEIGHT, SPARSE_WEIGHT), constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; an absent channel counts as ``missing_rank``, or as nothing if that is None."""

    def part(weight: float, rank: str) -> Column:
        if missing_rank is None:
            return F.coalesce(weight / (constant + F.col(rank)), F.lit(0.0))
        return weight / (constant + F.coalesce(rank, F.lit(missing_rank)))

    rows = both(dense, sparse).withColumn("score", F.round(part(weights[0], "dense_rank") + part(weights[1], "sparse_rank"), 8))
    return ranked(rows, k, rank="final_rank")


def ensemble(channels: dict[str, DataFrame], k: int = 10, weights: dict[str, float] | None = None, constant: int = RRF_K) -> DataFrame:
    """Fusion of any number of channels, with the names of those that found a result, in order of name."""
    rows = None
    for name, channel in channels.items():
        one = dedupe(channel).select("query_id", "doc_id", F.lit(name).alias("channel"), (F.lit((weights or {}).get(name, 1.0)) / (constant + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    total = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 8).alias("score"), F.array_join(F.array_sort(F.collect_list("channel")), "+").alias("sources"))
    return ranked(total, k)


def min_max(channel: DataFrame, flat: float = 0.0) -> DataFrame:
    """Scores on the scale 0 to 1 within a query; ``flat`` where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return channel.withColumn("score", F.when(high == low, F.lit(flat)).otherwise((F.col("score") - low) / (high - low)))


def weighted(dense: DataFrame, sparse: DataFrame, k: int = 10, weights: tuple[float, float] = (DENSE_WEIGHT, SPARSE_WEIGHT), flat: float = 0.0) -> DataFrame:
    """Weighted sum of min-max scores over the union of both channels; an absent one counts as 0."""
    rows = both(min_max(dedupe(dense), flat), min_max(dedupe(sparse), flat))
    total = weights[0] * F.coalesce("dense_score", F.lit(0.0)) + weights[1] * F.coalesce("sparse_score", F.lit(0.0))
    return ranked(rows.withColumn("score", F.round(total, 8)), k, rank="final_rank")


#: Names of the strategies that fuse() knows.
STRATEGIES = ("RRF", "RRF_MISSING_RANK", "WEIGHTED_SUM", "DENSE_ONLY", "SPARSE_ONLY")


def fuse(strategy: str, dense: DataFrame, sparse: DataFrame, k: int = 10) -> DataFrame:
    """Fusion of two channels by a strategy's name: query_id, doc_id, dense_rank, sparse_rank, score, final_rank."""
    name = strategy.upper()
    if name not in STRATEGIES:
        raise ValueError(strategy)
    if name == "DENSE_ONLY":
        return rrf(dense, sparse.where("false"), k)
    if name == "SPARSE_ONLY":
        return rrf(dense.where("false"), sparse, k)
    return weighted(dense, sparse, k) if name == "WEIGHTED_SUM" else rrf(dense, sparse, k, MISSING if name == "RRF_MISSING_RANK" else None)


def membership(fused: DataFrame, missing: int = MISSING) -> Column:
    """Which channels found a row: both, dense_only or sparse_only."""
    d, s = F.coalesce("dense_rank", F.lit(missing)) < missing, F.coalesce("sparse_rank", F.lit(missing)) < missing
    return F.when(d & s, "both").when(d, "dense_only").otherwise("sparse_only")


def explanation(fused: DataFrame) -> DataFrame:
    """Per query: how many results came from which channels, and a sentence that says so."""
    counted = fused.withColumn("channel", membership(fused)).groupBy("query_id").agg(*[F.count_if(F.col("channel") == c).alias(c) for c in ("dense_only", "sparse_only", "both")], F.count(F.lit(1)).alias("total"))
    return counted.withColumn("analysis", F.format_string("%d results: %d dense only, %d sparse only, %d both", "total", "dense_only", "sparse_only", "both"))


def compare(fused: DataFrame, docs: DataFrame, preview: int = 100) -> DataFrame:
    """Fused rows with their channel membership and the beginning of their text."""
    from larkspine.functions.text import truncate

    texts = docs.select("doc_id", truncate(F.col("text"), preview).alias("preview"))
    return fused.join(texts, "doc_id").select("query_id", "doc_id", "final_rank", membership(fused).alias("channel"), "preview")
