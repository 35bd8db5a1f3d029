"""Functions for spark.sql against the Column builders and chunkers of their names."""

import pytest
from pyspark.sql import functions as F

from larkspine.functions import session, text, vector
from larkspine.operators import chunkers

TEXTS = ["A cat, a dog; the cat's  tail", "全文检索 engine 搜索Spark引擎, ok", "", None, "x" * 250 + "\n\nsecond part. " * 30, " - "]


@pytest.fixture(scope="module")
def rows(spark):
    session.register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    df.createOrReplaceTempView("session_texts")
    return df


@pytest.mark.parametrize("name", ["tokens_basic", "tokens_mixed"])
def test_tokens(spark, rows, name):
    want = {r.i: r.v for r in rows.select("i", getattr(text, name)(F.col("t")).alias("v")).collect()}
    assert {r.i: r.v for r in spark.sql(f"SELECT i, {name}(t) AS v FROM session_texts").collect()} == want


def test_slices(spark, rows):
    want = {r.i: r.v for r in rows.select("i", chunkers.slices(F.col("t"), 40, 7).alias("v")).collect()}
    assert {r.i: r.v for r in spark.sql("SELECT i, chunk_slices(t, 40, 7) AS v FROM session_texts").collect()} == want


@pytest.mark.parametrize("name", sorted(session.PYTHON_FUNCTIONS))
def test_chunkers(spark, rows, name):
    want = {i: session.PYTHON_FUNCTIONS[name](t or "", 60, 10) for i, t in enumerate(TEXTS)}
    assert {r.i: r.v for r in spark.sql(f"SELECT i, {name}(t, 60, 10) AS v FROM session_texts").collect()} == want


def test_cosine(spark, rows):
    pairs = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    pairs.createOrReplaceTempView("session_pairs")
    got = [r.v for r in spark.sql("SELECT cosine(a, b) AS v FROM session_pairs").collect()]
    assert got == [r.v for r in pairs.select(vector.cosine(F.col("a"), F.col("b")).alias("v")).collect()]


def test_bm25_term(spark, rows):
    assert spark.sql("SELECT bm25_term(2, 3, 10, 100, 80) AS v").first().v == pytest.approx(1.1451323 * 5.0 / (2 + 1.5 * (0.25 + 0.75 * 1.25)), rel=1e-6)
