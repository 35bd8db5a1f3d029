"""Indexes that approximate or change, against exact searches and rebuilds."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspine.operators import index, paths, retrieval, topk, vector_index

VECTORS = "doc_id long, embedding array<float>, label int"


def plain_best(queries, rows, k):
    """(query, doc, score, rank) by a plain loop; vectors of another length and zero vectors score 0."""
    out = []
    for q, v in queries:
        scored = []
        for d, w, *_ in rows:
            if d is None or w is None:
                continue
            a, b = np.array(v, float), np.array(w, float)
            s = 0.0 if len(a) != len(b) or not a.any() or not b.any() else float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
            scored.append((-round(s, 6) + 0.0, d))
        out += [(q, d, -s + 0.0, r + 1) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def some_vectors(seed, n, size=6, groups=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size)) * 3
    return [(i, np.float32(centres[i % groups] + rng.normal(size=size)).tolist(), i % groups) for i in range(n)]


def found(df):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect())


@pytest.fixture()
def rows():
    return some_vectors(1, 300) + [(300, [0.0] * 6, 0), (301, [1.0, 2.0], 1), (302, None, 1), (None, [1.0] * 6, 1), (5, [1.0] * 6, 2), (303, [1.0] * 6, 2), (304, [1.0] * 6, 3)]


QUERIES = [(1, [1.0] * 6), (2, [-1.0, 2.0, 0.5, 0.0, 1.0, -2.0]), (3, [0.0] * 6), (4, [1.0, 2.0]), (5, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0])]


def asked(spark, queries=QUERIES):
    return spark.createDataFrame(queries, "query_id long, embedding array<double>")


def test_dense_against_a_loop(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    want = plain_best(QUERIES, rows, 7)
    assert found(retrieval.dense(df, asked(spark), 7)) == want
    assert found(retrieval.dense(df, asked(spark), 7, block=2)) == want


@pytest.mark.parametrize("batch,k", [(1, 3), (7, 3), (1000, 3), (7, 400), (50, 1)])
def test_best_rows_in_pieces(rows, batch, k, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(topk, "SCORES", 40)
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    own = [q for q in QUERIES if len(q[1]) == 6]
    best = topk.best_rows(np.array([q for q, _ in own]), np.array([v for _, v in own]), k)
    for a in range(0, len(rows), batch):
        some = rows[a : a + batch]
        best.add(np.array([r[0] for r in some]), pa.array([r[1] for r in some], pa.list_(pa.float32())))
    got = sorted((q, d, s) for b in best.rows() for q, d, s in zip(*(c.to_pylist() for c in b.columns)))
    assert got == [(q, d, s) for q, d, s, _ in plain_best(own, rows, k)]


def test_searching_all_cells_is_exact(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, VECTORS)
    ix = vector_index.VectorIndex(spark, f"{tmp_path}/ix").create(df, 7)
    assert ix.exists() and ix.rows().count() == len([r for r in rows if r[0] is not None and r[1] is not None])
    assert found(ix.search(asked(spark), 7, probes=7)) == plain_best(QUERIES, rows, 7)
    few = [r for r in rows if r[2] == 3]
    assert found(ix.search(asked(spark), 4, probes=7, condition=F.col("label") == 3)) == plain_best(QUERIES, few, 4)


def test_cells_are_those_of_the_nearest_centroids(spark, rows, tmp_path):
    centroids = [(c, [float(i == c) for i in range(6)]) for c in range(6)]
    ix = vector_index.VectorIndex(spark, f"{tmp_path}/ix").create(spark.createDataFrame(rows, VECTORS), centroids=spark.createDataFrame(centroids, "cell int, centroid array<double>"))
    cell = lambda v: 0 if len(v) != 6 else int(np.argmax(v))
    got = {(r.doc_id, r.cell) for r in ix.rows().collect()}
    assert got == {(d, cell(v)) for d, v, _ in rows if d is not None and v is not None}
    for q, v in QUERIES:
        near = [0, 1] if len(v) != 6 else np.argsort(-np.array(v), kind="stable")[:2].tolist()
        own = [r for r in rows if r[0] is not None and r[1] is not None and cell(r[1]) in near]
        assert found(ix.search(asked(spark, [(q, v)]), 5, probes=2)) == plain_best([(q, v)], own, 5)


def recall(df, queries, ix, probes=None):
    exact = {r[:2] for r in found(retrieval.dense(df, queries, 10))}
    return len(exact & {r[:2] for r in found(ix.search(queries, 10, probes))}) / len(exact)


def test_recall_of_the_given_vectors(spark, data, tmp_path):
    """These have no groups, so that a neighbour may be in any cell: many have to be opened, and tuning says how many."""
    df = spark.read.parquet(f"{os.path.dirname(data)}/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    ix = vector_index.VectorIndex(spark, f"{tmp_path}/ix").create(df)
    queries = df.select(F.col("doc_id").alias("query_id"), "embedding")
    probes, share = ix.tune(queries.where("query_id % 20 = 10"))
    assert share >= 0.97 and ix.probes() == probes < len(ix.centroids())
    assert recall(df, queries.where("query_id % 20 = 0"), ix) >= 0.95


def test_recall_of_groups_and_pruned_partitions(spark, tmp_path):
    df = spark.createDataFrame(some_vectors(4, 4000, 8, 60), VECTORS)
    ix = vector_index.VectorIndex(spark, f"{tmp_path}/ix").create(df)
    queries = df.select(F.col("doc_id").alias("query_id"), "embedding")
    probes, _ = ix.tune(queries.where("query_id % 50 = 1"))
    assert probes <= len(ix.centroids()) // 4
    assert recall(df, queries.where("query_id % 50 = 0"), ix) >= 0.95
    scan = ix.opened([1, 2], F.col("label") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in scan and "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in scan
    files = lambda rows: rows.select("_metadata.file_path").distinct().count()
    assert files(ix.opened([1, 2])) < files(ix.rows()) / 4


def test_rows_come_and_go(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, VECTORS)
    ix = vector_index.VectorIndex(spark, f"{tmp_path}/ix").create(df.where("doc_id < 200"), 6)
    ix.add(df.where("doc_id >= 200"))
    assert found(ix.search(asked(spark), 7, probes=6)) == plain_best(QUERIES, rows, 7)
    before = {r[0]: r[1] for r in ix.rows().select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()}
    gone = [r[0] for r in rows if r[2] == 2 and r[0] is not None]
    n = ix.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    assert 0 < n <= 6 and found(ix.search(asked(spark), 7, probes=6)) == plain_best(QUERIES, left, 7)
    after = {r[0]: r[1] for r in ix.rows().select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()}
    kept = {f for f in before if f in after}
    assert len({f.split("cell=")[1].split("/")[0] for f in before} - {f.split("cell=")[1].split("/")[0] for f in kept}) <= n
    assert ix.delete(spark.createDataFrame([(-9,)], "doc_id long")) == 0


def test_an_index_of_nothing_and_of_equal_rows(spark, tmp_path):
    empty = vector_index.VectorIndex(spark, f"{tmp_path}/a").create(spark.createDataFrame([], VECTORS), 4)
    assert empty.search(asked(spark), 3).count() == 0
    same = [(i, [1.0] * 6, 0) for i in range(50)]
    ix = vector_index.VectorIndex(spark, f"{tmp_path}/b").create(spark.createDataFrame(same, VECTORS), 4)
    assert found(ix.search(asked(spark, QUERIES[:1]), 3)) == [(1, 0, 1.0, 1), (1, 1, 1.0, 2), (1, 2, 1.0, 3)]
    assert ix.search(spark.createDataFrame([(1, None)], "query_id long, embedding array<double>"), 3).count() == 0


# Keyword generations

DOCS = "doc_id long, text string"
WORDS = "alpha beta gamma delta the of cat dog".split()


def text(rng):
    return rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))


def state(ix, queries):
    top = ix.matches(retrieval.query_terms(queries, ix.distinct))
    best = retrieval.keyword_search(ix, queries, 5).select("query_id", "doc_id", "score", "rank")
    return sorted(map(tuple, ix.postings().collect())), sorted(map(tuple, best.collect())), ix.stats().first(), top.count()


@pytest.mark.parametrize("distinct", [False, True])
def test_changes_equal_a_rebuild(spark, tmp_path, distinct):
    rng = random.Random(3 + distinct)
    live = {i: text(rng) for i in range(25)}
    df = lambda some: spark.createDataFrame(list(some.items()), DOCS)
    queries = spark.createDataFrame([(1, "the cat"), (2, "alpha beta beta nowhere"), (3, "dog of gamma")], "query_id long, query string")
    ix = index.KeywordIndex(spark, f"{tmp_path}/ix", distinct).create(df(live))
    for step in range(3):
        files = {r[0] for r in ix._table("postings", ix._sums()).select("_metadata.file_path").distinct().collect()}
        if step != 1:
            some = {rng.randrange(40): text(rng) for _ in range(8)}
            ix.index_batch(df(some))
            live |= some
        else:
            some = [rng.randrange(45) for _ in range(6)]
            ix.delete_batch(spark.createDataFrame([(i,) for i in some], "doc_id long"))
            live = {i: t for i, t in live.items() if i not in some}
        assert files <= {r[0] for r in ix._table("postings", ix._sums()).select("_metadata.file_path").distinct().collect()}
        if step == 2:
            rebuilt = index.KeywordIndex(spark, f"{tmp_path}/again", distinct).create(df(live))
            assert state(ix, queries) == state(rebuilt, queries)
    merged = ix.merged(f"{tmp_path}/merged")
    assert state(merged, queries) == state(ix, queries) and merged._sums().gens == [0]
    ix.delete_batch(df(live).select("doc_id"))
    assert ix.postings().count() == 0 and ix.stats().first()["n_docs"] == 0 and retrieval.keyword_search(ix, queries, 5).count() == 0
    ix.index_batch(df({1: "the cat"}))
    assert [r.doc_id for r in retrieval.keyword_search(ix, queries, 5).collect()] == [1]


def test_a_broken_change_is_not_seen(spark, tmp_path):
    queries = spark.createDataFrame([(1, "cat dog")], "query_id long, query string")
    ix = index.KeywordIndex(spark, f"{tmp_path}/ix").create(spark.createDataFrame([(1, "the cat"), (2, "a dog here")], DOCS))
    before = state(ix, queries)
    ix.index_batch(spark.createDataFrame([(1, "dog dog"), (3, "cat")], DOCS))
    after = state(ix, queries)
    paths.delete(spark, f"{tmp_path}/ix/stats/gen=1")  # as if the change had died before its end
    assert state(ix, queries) == before
    ix.index_batch(spark.createDataFrame([(1, "dog dog"), (3, "cat")], DOCS))
    assert state(ix, queries) == after
    ix.merged(f"{tmp_path}/to")
    paths.delete(spark, f"{tmp_path}/to/stats")  # a merge that died leaves the old index as it was
    assert state(ix, queries) == after and not index.KeywordIndex(spark, f"{tmp_path}/to").exists()


# Buckets of chunks


def files_of(stored):
    return {r[0]: r[1] for r in stored.rows().select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()}


def test_changes_write_the_buckets_they_meet(spark, tmp_path):
    rng = random.Random(8)
    live = {f"k{i}": i for i in range(120)}
    df = lambda some: spark.createDataFrame(list(some.items()), "id string, v int")
    stored = index.ChunkIndex(df(live)).write_buckets(f"{tmp_path}/chunks", 16)
    for step in range(3):
        before = files_of(stored)
        if step == 1:
            some = {k: 0 for k in rng.sample(sorted(live), 3)}
            n = stored.delete(df(some).select("id"))
            live = {k: v for k, v in live.items() if k not in some}
        else:
            some = {f"k{rng.randrange(140)}": 1000 + step for _ in range(3)}
            n = stored.upsert(df(some))
            live |= some
        after = files_of(stored)
        assert {r.id: r.v for r in stored.index().rows.collect()} == live and 1 <= n <= 3
        bucket = lambda f: f.split("bucket=")[1].split("/")[0]
        assert {bucket(f) for f in set(before) ^ set(after)} <= {str(r[0]) for r in stored._dealt(df(some), 16).select("bucket").distinct().collect()}
    assert stored.delete(df(live).select("id")) <= 16 and stored.rows().count() == 0
    assert stored.delete(df({"nobody": 1}).select("id")) == 1 and stored.upsert(df({"a": 1})) == 1 and stored.index().rows.collect() == [("a", 1)]


def test_a_change_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    stored = index.ChunkIndex(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")).write_buckets(f"{tmp_path}/chunks", 4)

    def dies(*_):
        raise RuntimeError("the driver died")

    monkeypatch.setattr(stored, "_put", dies)
    with pytest.raises(RuntimeError):
        stored.upsert(spark.createDataFrame([("a", 9)], "id string, v int"))
    again = index.BucketedChunks(spark, f"{tmp_path}/chunks")
    assert sorted(again.index().rows.collect()) == [("a", 1), ("b", 2)]
    again.upsert(spark.createDataFrame([("a", 9)], "id string, v int"))
    assert sorted(again.index().rows.collect()) == [("a", 9), ("b", 2)]


@pytest.mark.parametrize("distinct,positions", [(False, False), (False, True), (True, False)])
def test_an_index_shuffles_each_posting_once(spark, tmp_path, monkeypatch, distinct, positions):
    """Tokens are counted within their document; then each file's rows go to one partition, and nothing is grouped or dealt again."""
    from collections import Counter

    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", f"w{i}"]) for _ in range(rng.choice([1, 3, 200])))) for i in range(60)] + [(60, ""), (61, None), (62, "x"), (63, "same " * 500)]
    plans, folder = {}, index.KeywordIndex._folder

    def seen(self, table, gen, rows, *by):
        plans[table] = rows._jdf.queryExecution().executedPlan().toString()
        folder(self, table, gen, rows, *by)

    monkeypatch.setattr(index.KeywordIndex, "_folder", seen)
    monkeypatch.setattr(index, "BUCKET_BYTES", 2000)
    ix = index.KeywordIndex(spark, f"{tmp_path}/ix", distinct, positions).create(spark.createDataFrame(docs, "doc_id long, text string"))
    assert plans["postings"].count("Exchange") == 1 and "Aggregate" not in plans["postings"]
    tokens = {i: [w.lower() for w in (t or "").split() if len(w) > 1 and (not distinct or w.isalpha())] for i, t in docs}
    want = {(i, w, 1 if distinct else n) for i, ws in tokens.items() for w, n in Counter(ws).items()}
    assert sorted(map(tuple, ix.postings().collect())) == sorted(want)
    if positions:
        got = {(r.doc_id, r.term): r.positions for r in ix.matches(spark.createDataFrame([(w,) for w in {w for _, w, _ in want}], "term string")).collect()}
        assert got == {(i, w): [a for a, x in enumerate(tokens[i]) if x == w] for i, w, _ in want}


def test_a_change_of_few_keys_shuffles_no_rows(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "id long, content string")
    stored = index.ChunkIndex(rows).write_buckets(f"{tmp_path}/b", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored._without(rows.where("id < 9").select("id"), [0, 1, 2, 3], 9)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        for most in (100, 0):
            monkeypatch.setattr(index, "MOST_KEYS", most)
            stored.delete(rows.where(f"id % 50 = {most % 7}").select("id"))
            stored.upsert(rows.where("id = 60").withColumn("content", F.lit("new")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    gone = {i for i in range(200) if i % 50 in (0, 2)}
    assert {tuple(r) for r in stored.rows().select("id", "content").collect()} == {(i, "new" if i == 60 else f"t{i}") for i in range(200) if i not in gone}


@pytest.mark.parametrize("distinct,positions", [(False, False), (False, True), (True, False)])
def test_an_index_shuffles_a_row_for_each_document_and_bucket(spark, tmp_path, monkeypatch, distinct, positions):
    """Not one for each posting; tokens with spaces within, repeats and documents without tokens come through."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["aa", "bb,cc", "dd", "中,国", "x"]) + chr(97 + rng.randrange(26)) * rng.randrange(3) for _ in range(150))) for i in range(20)] + [(20, None), (21, " . "), (22, "中,国")]
    table = spark.createDataFrame(docs, DOCS)
    dealt, deal = [], type(table).repartitionById
    monkeypatch.setattr(type(table), "repartitionById", lambda self, *a: dealt.append(self.select("doc_id", "bucket").collect()) or deal(self, *a))
    monkeypatch.setattr(index, "BUCKET_BYTES", 4000)
    ix = index.KeywordIndex(spark, f"{tmp_path}/ix", distinct, positions).create(table)
    want = sorted(map(tuple, index.postings(table, distinct).select("doc_id", "term", "tf").collect()))
    assert sorted(map(tuple, ix.postings().collect())) == want
    (rows,) = dealt
    assert ix._sums().buckets > 1 and len(rows) == len(set(rows)) < len(want) / 2
