"""Predicates on promoted and other metadata keys give the rows of a filter on the map, and reach the scan."""

import random

import pytest
from pyspark.sql import functions as F

from larkspine.operators import filters
from larkspine.operators.metadata_table import MetadataTable

M = filters.MetadataFilter
SCHEMA = "id long, text string, metadata map<string,string>"


def some_rows(n=600):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        m = {"lang": rng.choice("de en fr".split()), "year": str(rng.randint(1990, 2024)), "source": f"src{rng.randint(0, 40):02d}"}
        if rng.random() < 0.3:
            m["author"] = rng.choice(["ann", "bob", None])
        if rng.random() < 0.02:
            m["rare"] = "x"
        if rng.random() < 0.1:
            del m["lang"]
        rows.append((i, f"t{i}", m))
    return rows + [(n, "none", {}), (n + 1, "null", None), (n + 2, "odd", {"": "empty key", "a.b`c": "1"})]


CONDITIONS = [
    M.eq("lang", "de"), M.ne("lang", "de"), M.eq("rare", "x"), M.eq("nope", "x"), M.ne("rare", "x"), M.isin("source", ["src03", "src17"]), M.isin("source", []), M.contains("source", "c1"),
    M().add("source", "STARTS_WITH", "src1"), M().add("author", "EXISTS"), M().add("year", "GREATER_THAN", "2010"), M().add("year", "LESS_THAN", "1995"), M().add("a.b`c", "EXISTS"), M(),
    filters.combine("AND", M.eq("lang", "en"), M.eq("rare", "x")), filters.combine("OR", M.eq("lang", "en"), M.eq("rare", "x")), filters.combine("OR", M.eq("lang", "fr"), filters.combine("AND", M.eq("source", "src01"), M.ne("author", "ann"))),
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    return df, MetadataTable(spark, str(tmp_path_factory.mktemp("meta"))).create(df, 8)


@pytest.mark.parametrize("i", range(len(CONDITIONS)))
def test_rows_are_those_of_the_map(both, i):
    df, table = both
    key = lambda r: (r["id"], r["text"], None if r["metadata"] is None else sorted(r["metadata"].items(), key=str))
    of = lambda k: F.try_element_at("metadata", F.lit(k))
    assert sorted(map(key, table.where(CONDITIONS[i]).collect()), key=str) == sorted(map(key, df.where(CONDITIONS[i].to_column(of)).collect()), key=str)


def test_scans_skip_data(both):
    df, table = both
    assert set(table.promoted()) == {"lang", "year", "source", "author"}
    plan = lambda m: table.where(m)._jdf.queryExecution().executedPlan().toString()
    year, lang = table.promoted()["year"], table.promoted()["lang"]
    assert f"EqualTo({year},2001)" in plan(M.eq("year", "2001")) and f"In({lang}, [de,fr])" in plan(M.isin("lang", ["de", "fr"]))
    assert f"StringStartsWith({year},200)" in plan(M().add("year", "STARTS_WITH", "200"))
    assert f"Or(EqualTo({lang},de),EqualTo({year},2001))" in plan(filters.combine("OR", M.eq("lang", "de"), M.eq("year", "2001")))


def test_fewer_rows_are_read(spark, both):
    _, table = both
    first = next(iter(table.promoted()))
    files = table.spark.read.parquet(f"{table.path}/rows").select("_metadata.file_path", table.promoted()[first]).distinct().collect()
    per_value = {}
    for f, v in files:
        per_value.setdefault(v, set()).add(f)
    assert len({f for f, _ in files}) >= 4 and min(len(f) for v, f in per_value.items() if v is not None) <= 2  # rows of a value lie in few files


def test_without_rows_or_keys(spark, tmp_path):
    empty = MetadataTable(spark, f"{tmp_path}/a").create(spark.createDataFrame([], SCHEMA))
    assert empty.where(M.eq("lang", "de")).collect() == []
    bare = MetadataTable(spark, f"{tmp_path}/b").create(spark.createDataFrame([(1, "t", {}), (2, "u", None)], SCHEMA))
    assert bare.where(M()).count() == 2 and bare.promoted() == {}
