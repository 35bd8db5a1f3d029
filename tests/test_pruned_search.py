"""Search by candidates against the plain search: same rows, fewer postings shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from larkspine.operators import index, pruned_search, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    """Words by Zipf's law: a few are in nearly every document."""
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 80)))) for i in range(1500)]
    docs += [(2000, None), (2001, ""), (2002, "w0 " * 3000), (2003, "w300 " * 50), (2004, docs[0][1]), (2005, docs[0][1])]
    asked = [(i, " ".join(rng.choices(vocabulary, k=3) + rng.choices(vocabulary, weights, k=6))) for i in range(20)]
    asked += [(100, "w0"), (101, "w0 w1 w2 w399"), (102, "unknown"), (103, None), (104, "w0 w0 w0 w300 w300"), (105, "w300 unknown"), (106, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select("query_id", "doc_id", "score", "rank", "matched_terms").collect())


@pytest.mark.parametrize("distinct", [False, True])
def test_same_results_as_the_plain_search(spark, corpus, tmp_path, distinct):
    docs, queries = corpus
    if distinct:  # tokenizer B takes letters only
        letters = lambda c: F.translate(c, "0123456789", "abcdefghij")
        docs, queries = docs.withColumn("text", letters("text")), queries.withColumn("query", letters("query"))
    found = index.KeywordIndex(spark, f"file://{tmp_path}/i", distinct).create(docs)
    for k in (1, 3, 10, 2000):
        want = rows(retrieval.keyword_search(found, queries, k))
        assert want == rows(pruned_search.pruned_search(found, queries, k, f"file://{tmp_path}/s"))
    assert want == rows(pruned_search.pruned_search(found, queries, 2000, f"file://{tmp_path}/s", most_broadcast=0))
    changed = found.index_batch(docs.where("doc_id < 30").withColumn("text", F.lit("aa w0 w399 cc"))).delete_batch(docs.where("doc_id % 7 = 3").select("doc_id"))
    assert rows(retrieval.keyword_search(changed, queries, 5)) == rows(pruned_search.pruned_search(changed, queries, 5, f"file://{tmp_path}/s"))


def test_few_documents_are_candidates(spark, corpus, tmp_path):
    docs, _ = corpus
    found = index.KeywordIndex(spark, f"file://{tmp_path}/i").create(docs)
    queries = spark.createDataFrame([(1, "w0 w1 w200 w201 w202")], "query_id long, query string")
    terms = pruned_search.required_terms(found, queries, 3, f"file://{tmp_path}/t")
    flags = {r["term"]: r["required"] for r in terms.collect()}
    assert not flags["w0"] and flags["w200"]
    some = pruned_search.candidates(found, terms, f"file://{tmp_path}/t")
    everything = found.matches(retrieval.query_terms(queries))
    kept = everything.join(some, ["query_id", "doc_id"], "left_semi")
    assert kept.count() * 5 < everything.count() > 1000
    best = retrieval.keyword_search(found, queries, 3).select("query_id", "doc_id")
    assert best.join(some, ["query_id", "doc_id"], "left_anti").isEmpty()


def test_candidates_are_broadcast_before_the_shuffle(spark, corpus, tmp_path):
    docs, queries = corpus
    found = index.KeywordIndex(spark, f"file://{tmp_path}/i").create(docs)
    plan = pruned_search.pruned_search(found, queries, 3, f"file://{tmp_path}/s")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
