import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspine.llm import decontaminate, exact_dedup, ngram_join, quality_fm, shared


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    before, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, data).cache()
        assert after.columns == docs.columns and after.count() < before.count()
        seen.append({r["doc_id"] for r in after.select("doc_id").collect()})
        before = after
    assert all(b < a for a, b in zip(seen, seen[1:]))
    first, second, third, _ = seen
    good = {r["doc_id"] for r in quality_fm.quality_scores(docs, spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 1").collect()}
    assert first == good
    assert second == {r["doc_id"] for r in exact_dedup.exact_dedup(docs.where(docs["doc_id"].isin(*first))).where("kept").collect()}
    assert third == {r["doc_id"] for r in ngram_join.ngram_join(docs.where(docs["doc_id"].isin(*second))).where("class_id = doc_id").collect()}
    assert not decontaminate.contaminated(before, spark.read.parquet(f"{data}/benchmark.parquet")).count()


ODD = [(None, None), (None, ""), (None, "null id"), (1, None), (2, ""), (3, " \n"), (4, "word " * 100_000), (5, "same text here"), (5, "same text here"), (6, "same  text here")]


@pytest.fixture(scope="module")
def odd(spark, data, tmp_path_factory):
    """A folder whose documents are odd rows and good ones, with an extra column of every name that operators use inside."""
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    more = {c: F.lit(0) for c in ("_bad", "bad", "rows", "gone", "_gone", "kept", "rep", "size", "rank", "norm", "score", "text_sha256", "keep_id", "class_id", "block", "of", "target")}
    both = docs.where("doc_id > 6").unionByName(rows).withColumns(more)
    both.write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_odd_rows_go_through_every_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, odd)
        assert got.columns == docs.columns and 0 < got.count() <= docs.count(), name
    distinct = exact_dedup.keep_distinct(docs).select("doc_id", "text").collect()
    assert sorted(str(r["doc_id"]) for r in distinct if (r["text"] or "").replace(" ", "").strip() in ("", "sametexthere", "nullid")) == ["3", "6", "None"]
    mixed = corpus_pipeline.mixed(spark, docs, odd).collect()
    assert mixed and all(r["size"] > 0 and r["taken"] == r["copies"] * r["size"] for r in mixed)
    run = corpus_pipeline.run(spark, odd)
    assert run.count() > 0 and run.where("doc_id in (1, 2, 3)").count() == 0


def test_stages_of_an_empty_table(spark, odd, data, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_runs_agree_and_leave_one_table(spark, data):
    before = len(shared._OWN)
    one = sorted(map(str, corpus_pipeline.run(spark, data).collect()))
    assert len(shared._OWN) == before + 1
    assert one == sorted(map(str, corpus_pipeline.run(spark, data).collect()))


def test_run_gives_the_mix(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["doc_id", "source", "size", "copies", "taken", "target"]
    assert got.where("taken <> copies * size or copies not in (1, 2)").count() == 0
