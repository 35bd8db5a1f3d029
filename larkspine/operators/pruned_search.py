"""Keyword search for the best k that shuffles few postings of frequent words, with exact results.

A plain search shuffles every posting of every word of a query by (query, document), so one frequent word moves a row for nearly every document.
Here a query's rare words are added up first.  The k-th best of these sums is a threshold that the k-th best
document reaches at least.  What a word can add to any document is bounded by its weight, so the words of least weight whose bounds
together stay below the threshold can't bring a document among the best alone (``required`` is false).  The candidates are the documents
of the other words, as far as their sums, with all that the first could add, reach the threshold.  They are counted and broadcast to the
postings, so of frequent words only the candidates' rows are shuffled.

Defined cases: a query with fewer than k documents of rare words has no threshold, and all its words are required; a query without
known words has no rows; repeated words count repeatedly.  Scores, ties and ranks are those of ``keyword_search``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspine.operators import retrieval
from larkspine.operators.index import KeywordIndex

#: Postings of a query's rare words, as a share of the documents.
RARE = 0.02
#: Scores are rounded to six digits, so sums this near count as equal.
MARGIN = 2e-6
#: Candidates up to this number are broadcast; more are joined by a shuffle.
MOST_CANDIDATES = 1_000_000


def required_terms(index: KeywordIndex, queries: DataFrame, k: int, folder: str, k1: float = retrieval.K1, b: float = retrieval.B, rare: float = RARE) -> DataFrame:
    """query_id, term, qtf, bound, required, threshold (null: none), rest: what the words that are not required add at most."""
    spark = index.spark
    most = (k1 + 1) / (1 + k1 * (1 - b)) if index.distinct else k1 + 1
    known = index.frequencies(retrieval.query_terms(queries, index.distinct)).withColumn("bound", F.col("qtf") * retrieval.idf() * most)
    upto = F.sum("df").over(Window.partitionBy("query_id").orderBy("df", "term"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term")) == 1
    known = _written(spark, known.withColumn("rare", first | (upto <= rare * F.col("n_docs"))).drop("df", "n_docs", "avgdl"), f"{folder}/words")
    sums = _sums(index.matches(known.where("rare").select("query_id", "term", "qtf")), k1, b)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sum")))
    threshold = sums.withColumn("n", place).where(F.col("n") == k).select("query_id", F.col("sum").alias("threshold"))
    below = F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", "term"))
    judged = known.join(threshold, "query_id", "left").withColumn("required", F.coalesce(below + MARGIN >= F.col("threshold"), F.lit(True)))
    rest = F.sum(F.when(F.col("required"), 0.0).otherwise(F.col("bound"))).over(Window.partitionBy("query_id"))
    return _written(spark, judged.withColumn("rest", rest).drop("rare"), f"{folder}/judged")


def candidates(index: KeywordIndex, terms: DataFrame, folder: str, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
    """query_id, doc_id of the documents that can be among the best, of ``required_terms``."""
    need = terms.where("required").select("query_id", "term", "qtf")
    level = terms.select("query_id", "threshold", "rest").distinct()
    reach = F.col("threshold").isNull() | (F.col("sum") + F.col("rest") + MARGIN >= F.col("threshold"))
    return _written(index.spark, _sums(index.matches(need), k1, b).join(level, "query_id").where(reach).select("query_id", "doc_id"), f"{folder}/candidates")


def pruned_search(index: KeywordIndex, queries: DataFrame, k: int, folder: str, k1: float = retrieval.K1, b: float = retrieval.B, most_broadcast: int = MOST_CANDIDATES) -> DataFrame:
    """``keyword_search`` by candidates; ``folder`` is shared by driver and executors and holds the tables of this search, in a new folder each time."""
    folder = f"{folder}/search-{uuid.uuid4().hex}"
    terms = required_terms(index, queries, k, folder, k1, b)
    some = candidates(index, terms, folder, k1, b)
    if some.count() <= most_broadcast:
        some = F.broadcast(some)
    matched = index.matches(terms.select("query_id", "term", "qtf")).join(some, ["query_id", "doc_id"], "left_semi")
    return retrieval._best(matched, k, k1, b)


def _sums(matched: DataFrame, k1: float, b: float) -> DataFrame:
    return matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * retrieval.idf() * retrieval.saturation("tf", k1, b)).alias("sum"))


def _written(spark, rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
