"""Channels that fail or stall while they run, table functions, tables over JDBC in many tasks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from larkspine.functions import session
from larkspine.operators import channels, chunkers, retrieval
from larkspine.sources import loaders

GOOD = [(1, 5, 2.0, 1), (1, 6, 1.0, 2)]


def raising(batches):
    raise ConnectionError("the store is gone")


def stalling(batches):
    time.sleep(600)
    yield from batches


@pytest.fixture()
def found(spark):
    return spark.createDataFrame(GOOD, channels.HITS)


@pytest.mark.parametrize("how", [raising, stalling, "planning"])
def test_a_channel_that_fails_leaves_the_other(spark, found, tmp_path, how):
    bad = (lambda q, k: spark.read.parquet(f"{tmp_path}/nowhere")) if how == "planning" else (lambda q, k: found.coalesce(1).mapInArrow(how, channels.HITS))
    good = lambda q, k: found
    queries = spark.createDataFrame([(1, "x")], "query_id long, query string")
    began = time.monotonic()
    for dense, sparse in ((bad, good), (good, bad)):
        both = retrieval.HybridRetriever(dense, sparse, timeout_s=15 if how is stalling else 120, folder=str(tmp_path))
        assert [r.doc_id for r in both(queries, 5).orderBy("rank").collect()] == [5, 6]
    got = both.outcomes(queries)
    assert got["dense"].error is None and got["sparse"].error and sorted(map(tuple, got["dense"].hits.collect())) == GOOD
    if how is stalling:
        assert "within 15 s" in got["sparse"].error and time.monotonic() - began < 90
    assert spark.range(3).count() == 3  # others' jobs are not cancelled


def test_channels_that_all_work(spark, found, tmp_path):
    got = channels.run(spark, {"a": lambda: found, "b": lambda: found.where("doc_id = 6"), "c": lambda: found.limit(0)}, str(tmp_path), 120)
    assert [len(o.hits.collect()) for o in got.values()] == [2, 1, 0] and not any(o.error for o in got.values())
    with pytest.raises(ValueError, match="folder"):
        retrieval.HybridRetriever(None, None, timeout_s=1).outcomes(found)


TEXTS = ["", None, "short", "# Head\n\nSome text. More of it, with commas.\n\n## Sub\n\n" + "word " * 200, "x" * 333, "class A:\n  pass\nclass B:\n" + "  y = 1\n" * 60]


@pytest.mark.parametrize("name", list(session.ChunkTexts.STRATEGIES))
def test_table_function(spark, name):
    session.register(spark)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk string")
    got = sorted(map(tuple, spark.sql(f"SELECT * FROM chunk_texts(TABLE(SELECT * FROM {{docs}}), '{name}', 100, 20)", docs=docs).collect()))
    if name == "slices":
        want = chunkers.exploded(docs, chunkers.slices(F.col("text"), 100, 20))
    elif name == "parents":
        want = chunkers.chunked(docs, chunkers._Bound(chunkers.parent_slices, 100, 20))
    else:
        want = chunkers.strategy(name, 100, 20)(docs)
    assert got == sorted(map(tuple, want.collect())) and len(got) > 5
    again = spark.sql(f"SELECT * FROM chunk_texts(TABLE(SELECT * FROM {{docs}}) PARTITION BY (doc_id), '{name}', 100, 20)", docs=docs)
    assert sorted(map(tuple, again.collect())) == got


@pytest.mark.parametrize("args", ["TABLE(SELECT 1 AS doc_id), 'slices', 100, 20", "TABLE(SELECT 1 AS doc_id, 'a' AS text), 'nope', 100, 20", "TABLE(SELECT 1 AS doc_id, 'a' AS text), 'slices', 100, 100"])
def test_table_function_refuses(spark, args):
    session.register(spark)
    with pytest.raises(Exception, match="doc_id and text|strategy|overlap"):
        spark.sql(f"SELECT * FROM chunk_texts({args})").collect()


URL = "jdbc:derby:memory:{};create=true"


def derby(spark, name, rows):
    df = spark.createDataFrame(rows, "k long, v string")
    df.coalesce(1).write.jdbc(URL.format(name), "t", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    return URL.format(name)


@pytest.mark.parametrize("kind", ["even", "close", "one", "nulls", "none", "negative"])
def test_jdbc_in_many_tasks(spark, kind):
    rng = random.Random(3)
    keys = {
        "even": list(range(400)),
        "close": [rng.randint(0, 300) for _ in range(380)] + [10**12 + rng.randint(0, 10**6) for _ in range(20)],
        "one": [7] * 300 + list(range(100)),
        "nulls": [None] * 50 + list(range(350)),
        "none": [],
        "negative": [rng.randint(-10**9, 10**9) for _ in range(400)],
    }[kind]
    rows = [(k, f"v{i}") for i, k in enumerate(keys)]
    try:
        url = derby(spark, kind, rows)
    except Exception as e:
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no Derby here")
        raise
    got = loaders.jdbc_by(spark, url, "t", '"k"', 8, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(rows, "k long, v string").collect()))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    if kind in ("even", "close", "negative", "nulls"):
        assert 8 <= len(sizes) <= 18 and max(sizes) <= 60
    if kind == "one":
        assert len(sizes) >= 3
