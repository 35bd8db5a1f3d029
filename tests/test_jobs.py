"""The jobs: growing input, repeated and broken runs, odd rows, the command line."""

import json
import os
import random
import subprocess
import sys

import pytest
from tests.conftest import ROOT
from pyspark.sql import functions as F

from jobs import chunk_corpus, sync_documents
from jobs.settings import settings

DOCS = "doc_id long, text string, lang string, source string"
SMALL = sync_documents.Settings(size=20, overlap=5, buckets=3)


def cut(text, size=20, step=15):
    return [text[i : i + size] for i in range(0, max(len(text) - size + step - 1, 0) // step * step + 1, step)] if text else []


def put(spark, rows, folder, schema=DOCS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def texts(seed, ids):
    rng = random.Random(seed)
    return {i: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) for i in ids}


def store(spark, out):
    rows = sync_documents.current(spark, out).orderBy("doc_id", "chunk_index").collect()
    return [(r.doc_id, r.chunk_index, r.chunk, r.version, r.action) for r in rows]


def wanted(state):
    return [(i, k, c, v, "CREATED" if v == 1 else "UPDATED") for i, (t, v) in sorted(state.items()) for k, c in enumerate(cut(t))]


def rows_of(found):
    return [(i, t, "en", "s") for i, t in found.items()]


def test_cut_is_what_the_chunker_does(spark):
    from larkspine.operators import chunkers

    found = texts(0, range(40))
    got = spark.createDataFrame(rows_of(found), DOCS).select("doc_id", chunkers.slices(F.col("text"), 20, 5).alias("c")).collect()
    assert {r.doc_id: r.c for r in got} == {i: cut(t) for i, t in found.items()}


def test_sync_takes_only_what_is_new(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: sync_documents.run(spark, source, out, mark, SMALL)
    first = texts(1, range(20))
    put(spark, rows_of(first), source)
    got = run()
    assert (got["batches"], got["total"], got["created"]) == (1, 20, 20)
    state = {i: (t, 1) for i, t in first.items()}
    assert store(spark, out) == wanted(state)
    assert run()["batches"] == 0 and store(spark, out) == wanted(state)
    # The input grows: new documents, changed ones, and some that are as they were.
    second = texts(2, range(15, 30)) | {0: first[0], 1: first[1]}
    put(spark, rows_of(second), source)
    got = run()
    assert (got["batches"], got["total"], got["created"], got["updated"], got["skipped"]) == (1, 17, 10, 5, 2)
    state |= {i: (t, 2 if i < 20 else 1) for i, t in second.items() if i >= 15}
    assert store(spark, out) == wanted(state)
    before = sorted(map(str, sync_documents.table(spark, f"{out}/registry", sync_documents.REGISTRY).collect()))
    assert run()["batches"] == 0
    assert sorted(map(str, sync_documents.table(spark, f"{out}/registry", sync_documents.REGISTRY).collect())) == before


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    out = str(tmp_path)
    first, second = texts(3, range(12)), texts(4, range(6, 18))
    batch = lambda found: spark.createDataFrame(rows_of(found), DOCS).withColumn("came", F.lit("2024-01-01").cast("timestamp"))
    sync_documents.take(batch(first), 0, out, SMALL)
    one = sync_documents.take(batch(second), 1, out, SMALL)
    kept = store(spark, out)
    assert sync_documents.take(batch(second), 1, out, SMALL) == one and store(spark, out) == kept
    # Chunks of a batch whose registry was not written yet don't count.
    batch(texts(5, range(3))).select(F.lit("x").alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"), F.lit(2).cast("long").alias("batch"), F.lit(0).alias("bucket")).write.mode("append").partitionBy("batch", "bucket").parquet(f"{out}/chunks")
    assert store(spark, out) == kept


def test_sync_in_random_pieces_ends_as_one(spark, tmp_path):
    rng, state = random.Random(6), {}
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for step in range(4):
        some = texts(10 + step, rng.sample(range(15), 8))
        put(spark, rows_of(some), source)
        sync_documents.run(spark, source, out, mark, SMALL)
        for i, t in some.items():
            old, v = state.get(i, (None, 0))
            state[i] = (t, v if t == old else v + 1)
    assert store(spark, out) == wanted(state)


def test_sync_of_odd_rows(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = [(1, None), (2, ""), (3, "b" * 50), (3, "a" * 50), (3, "a" * 50), (None, "lost"), (4, "x" * 100_000)]
    put(spark, [(i, t, None, None, "extra") for i, t in rows], source, DOCS + ", chunk string")
    got = sync_documents.run(spark, source, out, mark, SMALL)
    assert (got["total"], got["created"], got["failed"]) == (4, 3, 1)
    log = {r.doc_id: (r.action, r.version, r.n_chunks) for r in sync_documents.table(spark, f"{out}/registry", sync_documents.REGISTRY).collect()}
    assert log == {1: ("FAILED", None, 0), 2: ("CREATED", 1, 0), 3: ("CREATED", 1, 3), 4: ("CREATED", 1, len(cut("x" * 100_000)))}
    assert {r[2] for r in store(spark, out) if r[0] == 3} == {"a" * 20}
    put(spark, [(1, "now it is there", None, None, "")], source, DOCS + ", chunk string")
    assert sync_documents.run(spark, source, out, mark, SMALL)["created"] == 1


def corpus(spark, rows, toxic, out, **more):
    rows.write.mode("overwrite").parquet(f"{out}/in")
    spark.createDataFrame([(i, 1) for i in toxic] + [(None, 1)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{out}/labels")
    got = chunk_corpus.run(spark, f"{out}/in", f"{out}/labels", f"{out}/corpus", chunk_corpus.Settings(size=20, overlap=5, **more))
    found = chunk_corpus.current(spark, f"{out}/corpus").orderBy("doc_id", "chunk_index").collect()
    assert got["chunks"] == len(found)
    return [(r.doc_id, r.chunk_index, r.chunk, r.lang, r.n_copies) for r in found]


def plain_corpus(rows, toxic):
    seen = {}
    for i, t, lang, _ in sorted((r for r in rows if r[0] is not None and r[0] not in toxic), key=lambda r: r[0]):
        for k, c in enumerate(cut(t or "")):
            seen.setdefault(c, []).append((i, k, lang or "und"))
    return sorted((*min(p[:2] for p in places), c, min(places)[2], len(places)) for c, places in seen.items())


def test_corpus_against_a_loop_and_again(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i - 5, t, rng.choice(["en", "de", "", None, "07"]), "s") for i, t in texts(7, range(60)).items()]
    rows += [(100 + i, rows[i % 9][1], "fr", None) for i in range(40)] + [(None, "no id", "en", "s"), (300, None, "en", "s"), (301, "", "en", "s"), (302, "y" * 70_000, "en", "s")]
    toxic = [0, 3, 7]
    want = sorted((i, k, c, lang, n) for i, k, c, lang, n in plain_corpus(rows, toxic))
    df = spark.createDataFrame(rows, DOCS)
    assert corpus(spark, df, toxic, str(tmp_path)) == want
    assert corpus(spark, df, toxic, str(tmp_path)) == want
    report = spark.read.schema(chunk_corpus.REPORT).json(f"{tmp_path}/corpus/report").collect()
    assert sum(r.chunks for r in report) == len(want) and sum(r.copies for r in report) == sum(w[4] - 1 for w in want)
    # A language that has gone is not there any more.
    less = [r for r in rows if r[2] != "de"]
    assert corpus(spark, spark.createDataFrame(less, DOCS), toxic, str(tmp_path)) == plain_corpus(less, toxic)


def test_corpus_of_nothing(spark, tmp_path):
    assert corpus(spark, spark.createDataFrame([], DOCS), [1], str(tmp_path)) == []


def test_jobs_change_no_setting(spark, tmp_path):
    before = dict(spark.conf.getAll)
    corpus(spark, spark.createDataFrame([(1, "text", "en", "s")], DOCS), [], str(tmp_path))
    put(spark, [(1, "text", "en", "s")], tmp_path / "in2")
    sync_documents.run(spark, str(tmp_path / "in2"), str(tmp_path / "out"), str(tmp_path / "mark"), SMALL)
    assert dict(spark.conf.getAll) == before and not spark.streams.active


def test_settings(tmp_path):
    for kind, name in ((chunk_corpus.Settings, "chunk_corpus"), (sync_documents.Settings, "sync_documents")):
        assert settings(kind, f"{ROOT}/jobs/{name}.json") == kind()
    (tmp_path / "bad.json").write_text(json.dumps({"sise": 3}))
    with pytest.raises(ValueError, match="sise"):
        settings(sync_documents.Settings, tmp_path / "bad.json")


def test_command_line(spark, data, tmp_path):
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    args = [sys.executable, "-m", "jobs.sync_documents", "--documents", f"{data}/documents.parquet", "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
    for n in (1, 0):
        said = subprocess.run(args, cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert said.returncode == 0 and f"took {n} batches" in said.stderr, said.stderr[-2000:]
    assert sync_documents.current(spark, str(tmp_path / "out")).count() > 0
