import hashlib
import math
import struct

import pytest
from pyspark.sql import functions as F

from larkspine.functions import models, parsers, text, vector
from larkspine.operators import filters, fusion, incremental, index, rerank, retrieval, text2sql
from larkspine.plans import pipelines
from larkspine.sources import loaders, sinks
from larkspine.streaming import ingest

M = filters.MetadataFilter


def one(spark, column, *values):
    names = [chr(97 + i) for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names))).first()[0]


def test_tokenizers(spark):
    assert one(spark, text.tokens_basic, "The k8s, the A é-tude 机器 x") == ["the", "k8s", "the", "tude"]
    assert one(spark, text.tokens_mixed, "Hello hello word, k8s 机器学习 a") == ["hello", "机器", "器学", "学习", "机器学", "器学习", "机器学习"]
    assert one(spark, text.tokens_unicode, "Étude, 机器 a étude") == ["étude", "机器", "a"]


@pytest.mark.parametrize("answer,score", [("Score: 7.5", 7.5), ("15", 10.0), ("highly relevant", 8.0), ("medium", 5.0), ("low", 2.0), ("irrelevant", 2.0), ("不相关", 2.0), ("", 5.0)])
def test_rating(spark, answer, score):
    assert one(spark, parsers.rating, answer) == score


def test_rating_parity(spark):
    assert one(spark, lambda a: parsers.rating(a, True), "irrelevant") == 8.0


@pytest.mark.parametrize("answer,want", [("correct|fits", ("CORRECT", "fits")), ("INCORRECT", ("INCORRECT", "")), ("it is correct | a|b", ("CORRECT", "a|b")), ("不相关", ("INCORRECT", "")), ("?", ("AMBIGUOUS", ""))])
def test_grade(spark, answer, want):
    assert tuple(one(spark, parsers.grade, answer)) == want


def test_parsers(spark):
    assert one(spark, parsers.sql_of, "```sql\nSELECT 1\n```") == "SELECT 1" and one(spark, parsers.sql_of, "SQL: SELECT 2") == "SELECT 2"
    assert one(spark, parsers.clean_extract, "以下是：```text\nbody\n```") == "body"
    assert tuple(one(spark, parsers.structured, '```json\n{"sortBy":"price","order":"ASC","limit":3,"query":"q"}\n```')) == ("price", "asc", 3, "q")
    assert one(spark, parsers.variations, "1. first one\n2) no\n\nsecond line") == ["first one", "second line"]
    assert one(spark, parsers.bullets, "x\n- a\n• b\n- q", "q") == ["a", "b"]
    assert one(spark, parsers.intent, "how_to!") == "HOW_TO" and one(spark, parsers.intent, "?") == "INFORMATIONAL"
    assert one(spark, parsers.step_back_guard, "a long question here", "a long question here and more") is None
    assert one(spark, lambda q: parsers.drop_similar(q, F.array(F.lit("a b c"), F.lit("x y"))), "a b c") == ["x y"]
    assert [one(spark, parsers.relevant, a) for a in ("相关", "不相关", "irrelevant", None)] == [True, False, False, True]
    got = one(spark, parsers.self_query, "语义查询: 论文\n过滤条件:\n- year: gte=2023\n- author: ne=张三\n")
    assert got["query"] == "论文" and [tuple(c) for c in got["conditions"]] == [("year", "EQUALS", "2023"), ("author", "NOT_EQUALS", "张三")]
    assert one(spark, parsers.self_query, "语义查询: 无\n过滤条件: none")["conditions"] == []


@pytest.mark.parametrize(
    "f,want",
    [
        (M.eq("k", "5"), [1]), (M.ne("k", "5"), [2, 3, 4]), (M.contains("k", "b"), [3]), (M().add("k", "STARTS_WITH", "a"), [3]), (M().add("k", "ENDS_WITH", "c"), [3]),
        (M().add("k", "EXISTS"), [1, 2, 3]), (M.isin("k", ["5", "abc"]), [1, 3]), (M.isin("k", []), []), (M().add("k", "GREATER_THAN", "9"), [2, 3]),
        (M().add("k", "LESS_THAN", "9"), [1]), (M().add("k", "LESS_THAN", "b"), [1, 2, 3]), (M(), [1, 2, 3, 4]), (filters.combine("OR", M.eq("k", "5"), M.eq("k", "10")), [1, 2]),
    ],
)
def test_filters(spark, f, want):
    rows = spark.createDataFrame([(1, {"k": "5"}), (2, {"k": "10"}), (3, {"k": "abc"}), (4, {"j": "1"})], "id int, m map<string,string>")
    assert [r["id"] for r in rows.where(f.to_column(lambda k: F.try_element_at("m", F.lit(k)))).orderBy("id").collect()] == want


def test_filter_sql_is_quoted(spark):
    rows = spark.createDataFrame([("it's",), ("x",)], "k string")
    assert rows.where(M.eq("k", "it's").to_sql()).count() == 1 and rows.where(M.isin("k", ["x", "y"]).to_sql()).count() == 1 and M().to_sql() == "true"
    with pytest.raises(ValueError):
        M().add("k", "LIKE", "x")


DOCS = [(1, "the cat sat"), (2, "the dog the cat"), (3, "a bird flew far away"), (4, "机器学习 cat")]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    q = spark.createDataFrame([(1, "cat cat dog")], "query_id long, query string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(docs, q, 10).collect()}
    avg = sum(len(t) for _, t in DOCS) / 4
    part = lambda df, tf, n: math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
    assert got == {1: round(2 * part(3, 1, 11), 6), 2: round(2 * part(3, 1, 15) + part(1, 1, 15), 6), 4: round(2 * part(3, 1, 8), 6)}
    han = retrieval.bm25(docs, spark.createDataFrame([(1, "学习")], "query_id long, query string"), 10, advanced=True).collect()
    assert [(r["doc_id"], r["matched_terms"]) for r in han] == [(4, ["学习"])]
    assert retrieval.bm25(docs.limit(0), q, 10).count() == 0


def test_dense_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)] + [(30, [0.0, 0.0, 0.0]), (31, [1.0]), (32, None)], "doc_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(0, [1.0, 2.0, 1.0]), (1, [0.0, 0.0, 0.0]), (2, [2.0, 0.0, 1.0])], "query_id long, embedding array<float>")
    rows = sorted(map(str, retrieval.dense(v, q, 4).collect()))
    assert rows == sorted(map(str, retrieval.dense(v, q, 4, block=1).collect())) and len(rows) == 12
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))
    want = sorted((-round(cos([1.0, 2.0, 1.0], [i % 3, i % 5, 1]), 6), i) for i in range(30))[:4]
    assert [(-r["score"], r["doc_id"]) for r in retrieval.dense(v, q, 4).where("query_id = 0").orderBy("rank").collect()] == want


CH = "query_id long, doc_id long, score double, rank int"


def test_fusion_by_hand(spark):
    d = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], CH)
    s = spark.createDataFrame([(1, 11, 7.0, 1), (1, 12, 3.0, 2), (1, 11, 1.0, 3)], CH)
    got = {r["doc_id"]: (r["score"], r["final_rank"]) for r in fusion.rrf(d, s).collect()}
    assert got == {11: (round(0.7 / 62 + 0.3 / 61, 8), 1), 10: (round(0.7 / 61, 8), 2), 12: (round(0.3 / 62, 8), 3)}
    far = {r["doc_id"]: r["score"] for r in fusion.rrf(d, s, missing_rank=999).collect()}
    assert far[10] == round(0.7 / 61 + 0.3 / 1059, 8)
    w = {r["doc_id"]: r["score"] for r in fusion.weighted(d, s).collect()}
    assert w == {10: 0.7, 11: 0.3, 12: 0.0}
    flat = fusion.min_max(d.limit(1), 1.0).first()["score"], fusion.min_max(d.limit(1)).first()["score"]
    assert flat == (1.0, 0.0)
    e = fusion.explanation(fusion.rrf(d, s)).first()
    assert (e["dense_only"], e["sparse_only"], e["both"]) == (1, 1, 1)
    assert {r["sources"] for r in fusion.ensemble({"b": d, "a": s}).collect()} == {"b", "a", "a+b"}


def test_mmr():
    texts = ["a b c", "a b c", "x y z"]
    assert rerank.mmr_order([9, 8, 5], texts, 3, 1.0) == [0, 1, 2] and rerank.mmr_order([9, 8, 5], texts, 2, 0.3) == [0, 2]
    assert rerank.mmr_order([], [], 3, 0.5) == [] and rerank.mmr_order([1, 1], ["", None], 5, 0.5) == [0, 1]


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]


REG = "document_id string, content_hash string, status string, version int, storage_type string, index_time timestamp, update_time timestamp"


def test_sync_is_idempotent_and_spares_failures(spark):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    reg = spark.createDataFrame([("d/a", md5("a"), "ACTIVE", 1, "memory", None, None), ("d/b", md5("old"), "ACTIVE", 3, "memory", None, None), ("d/c", md5("c"), "ACTIVE", 1, "memory", None, None), ("d/f", md5("f"), "ACTIVE", 1, "memory", None, None), ("d/x", md5("x"), "DELETED", 2, "memory", None, None), ("d2/z", md5("z"), "ACTIVE", 1, "memory", None, None)], REG)
    inc = spark.createDataFrame([("d/a", "a"), ("d/b", "b"), ("d/n", "n"), ("d/f", None), ("d/x", "x")], "document_id string, content string")
    plan = incremental.plan(reg, inc, "d")
    assert {r["document_id"]: (r["action"], r["version"]) for r in plan.collect()} == {"d/a": ("SKIPPED", 1), "d/b": ("UPDATED", 4), "d/n": ("CREATED", 1), "d/f": ("FAILED", 1), "d/x": ("UPDATED", 3), "d/c": ("DELETED", 1)}
    after = incremental.apply(reg, plan).cache()
    again = {r["document_id"]: r["action"] for r in incremental.plan(after, inc, "d").collect()}
    assert again == {"d/a": "SKIPPED", "d/b": "SKIPPED", "d/n": "SKIPPED", "d/f": "FAILED", "d/x": "SKIPPED"}
    assert incremental.apply(reg, plan, physical=True).where("document_id = 'd/c'").count() == 0
    assert incremental.plan(reg, inc, "d", force=True).where("action = 'UPDATED'").count() == 3
    ids = spark.createDataFrame([("d/a",)], "document_id string")
    assert incremental.delete(reg, ids).where("status = 'DELETED'").count() == 2 and incremental.delete(reg, ids, True).count() == 5
    assert incremental.status(reg).count() == 6 and incremental.by_hash(reg, md5("z")).first()["document_id"] == "d2/z"


def test_index_lifecycle(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x y"), ("b", "y z")], "id string, content string")
    i = index.ChunkIndex(rows)
    assert i.upsert(spark.createDataFrame([("a", "new"), ("c", "c")], "id string, content string")).rows.count() == 3 and i.append(rows).rows.count() == 4
    assert i.delete(spark.createDataFrame([("a",)], "id string")).rows.count() == 1
    i.write(str(tmp_path / "i"), 2)
    assert index.ChunkIndex.read(spark, str(tmp_path / "i")).stats().first()["keys"] == 2


@pytest.mark.parametrize("distinct", [False, True])
def test_keyword_index_gives_what_a_scan_gives(spark, data, tmp_path, monkeypatch, distinct):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "机器学习 cat"), (-2, None), (-3, "")], "doc_id long, text string"))
    queries = spark.createDataFrame([(1, "the cat and the dog"), (2, "机器学习"), (3, ""), (4, "nowhere-to-be-found"), (5, docs.where("doc_id = 3").first()["text"][:300])], "query_id long, query string")
    k = index.KeywordIndex(spark, f"{tmp_path}/kw", distinct)
    assert not k.exists() and k.health() == "MISSING"
    assert k.create(docs).exists() and k.health() == "UP" and k.stats().first()["n_docs"] == docs.count()
    want = sorted(map(str, retrieval.bm25(docs, queries, 20, distinct).collect()))
    assert want and want == sorted(map(str, retrieval.keyword_search(k, queries, 20).collect()))
    monkeypatch.setattr(index, "MOST_TERMS", 2)
    assert want == sorted(map(str, retrieval.keyword_search(k, queries, 20).collect()))
    assert sorted(map(str, k.postings().collect())) == sorted(map(str, index.postings(docs, distinct).select("doc_id", "term", "tf").collect()))
    k.drop()
    assert not k.exists()


def test_chunk_index_search(spark):
    rows = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", 2, [0.9, 0.1])], "name string, kind int, embedding array<float>").select(F.ascii("name").cast("long").alias("id"), "kind", "embedding")
    found = index.ChunkIndex(rows)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["id"] for r in found.search(q, 2).orderBy("rank").collect()] == [97, 99]
    assert [r["id"] for r in found.search(q, 2, F.col("kind") == 1).orderBy("rank").collect()] == [97, 98]
    assert [r["id"] for r in found.search(q, 3, min_score=0.5).orderBy("rank").collect()] == [97, 99]
    assert found.health() == "UP" and index.ChunkIndex(rows.drop("id")).health() == "DOWN"


def test_text2sql(spark):
    spark.createDataFrame([(1, None), (2, "x")], "i int, s string").createOrReplaceTempView("t2s")
    got = text2sql.execute(spark, "SELECT i, s FROM t2s ORDER BY i;")
    assert got.columns == ["i", "s"] and got.rows == [["1", "NULL"], ["2", "x"]] and got.error is None
    for bad in ("DROP TABLE t2s", "SELECT 1; DROP TABLE t2s", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')"):
        assert text2sql.execute(spark, bad).error
    assert text2sql.execute(spark, "WITH a AS (SELECT 'x;y' AS b) SELECT * FROM a").rows == [["x;y"]]
    assert text2sql.validate(spark, "SELECT i FROM t2s") is None and text2sql.validate(spark, "SELECT nope FROM t2s")
    fixed = text2sql.run_with_repair(spark, "SELECT nope FROM t2s", lambda sql, error: sql.replace("nope", "i"))
    assert fixed.attempts == 2 and len(fixed.rows) == 2
    assert text2sql.run_with_repair(spark, "SELECT nope FROM t2s", lambda sql, error: sql).attempts == 3


def test_pipelines(spark):
    q = spark.createDataFrame([(1, "where is the cat"), (2, "nothing")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 5, "the cat sat", 1.0, 1), (1, 6, "[CENTER]mid[CENTER_END][AFTER]end[AFTER_END]", 0.5, 2)], "query_id long, doc_id long, text string, score double, rank int")
    a = {r["query_id"]: r for r in pipelines.answer(q, hits, models.echo_chat).collect()}
    assert a[1]["answer"] == "where is the cat" and a[1]["sources"] == [5, 6] and a[2]["answer"] == pipelines.EMPTY_ANSWER
    assert pipelines.context_of(hits).first()["context"] == "the cat sat\n\nmidend"
    broken = lambda prompts: 1 / 0
    assert pipelines.rewrite(q, broken).first()["confidence"] == 0.5
    g = {r["query_id"]: r["grade"] for r in pipelines.assess(q, hits, lambda ps: ["CORRECT|ok"] * len(ps)).collect()}
    assert g == {1: "CORRECT", 2: "INCORRECT"}
    search = lambda queries, k: hits
    assert pipelines.optimized_chat(q, search, models.echo_chat, None).count() == 2
    c = pipelines.compress(hits, F.lit("relevant"), F.lit("cat sat")).collect()
    assert [r["compressed"] for r in c] == ["cat sat", "cat sat"]
    assert pipelines.compress(hits, F.lit("irrelevant"), F.lit("x")).count() == 0 and pipelines.compress(hits, F.lit("relevant"), F.lit("")).first()["ratio"] == 1.0
    assert one(spark, lambda x: pipelines.expansions(x, F.lit("1. cats that sit\n2. where is the cat"), 3), "where is the cat") == ["where is the cat", "cats that sit"]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", w, h) + b"\x00" * 8


def test_loading_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.txt": "ünï".encode(), "b.pdf": b"%PDF", "empty.md": b"", "c.png": png(120, 200), "d.png": png(50, 200)}.items():
        (tmp_path / "in" / name).write_bytes(data)
    loaded = loaders.files(spark, str(tmp_path / "in"))
    got = {r["filename"]: r for r in loaders.parse(loaded, {"pdf": lambda b: b.decode()[1:]}).collect()}
    assert set(got) == {"a.txt", "b.pdf", "c.png", "d.png"} and got["a.txt"]["text"] == "ünï" and got["b.pdf"]["text"] == "PDF" and got["c.png"]["error"]
    assert [(r["filename"], r["width"], r["height"]) for r in loaders.images(loaded).collect()] == [("c.png", 120, 200)]
    assert loaders.image_info(b"GIF89a\x05\x00\x07\x00") == ("gif", 5, 7) and loaders.image_info(b"?") is None
    m = spark.createDataFrame([({"Author": "x", "title": "", "Other": "y", "Word-Count": "3"},)], "m map<string,string>")
    assert m.select(loaders.picked_metadata(F.col("m"))).first()[0] == {"author": "x", "word-count": "3"}
    blocks = spark.createDataFrame([([("TEXT", " a"), ("IMAGE", "x"), ("MARKDOWN", "b ")],)], "b array<struct<type:string,content:string>>")
    assert blocks.select(text.full_text(F.col("b"))).first()[0] == "a\n\nb" and blocks.select(F.size(text.image_blocks(F.col("b")))).first()[0] == 1
    assert blocks.select(loaders.block_texts(F.col("b"))).first()[0] == [" a", "[IMAGE 2]", "b "]
    assert one(spark, lambda n: text.image_index_text(n, F.lit("d"), F.lit(3), F.lit(4), F.lit("png")), "f") == "【图像内容】\n文件名: f\n描述: d\n尺寸: 3x4\n格式: png\n"


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b. c d."), (2, "e f.")], "doc_id long, text string")
    from larkspine.operators import chunkers

    ix = sinks.index_documents(docs, chunkers.strategy("fixed", 50, 0)(docs), models.hash_embedder, F.create_map(F.lit("k"), F.lit("v")))
    sinks.dual_write(ix, str(tmp_path / "v"), str(tmp_path / "k"))
    back = spark.read.parquet(str(tmp_path / "v")).orderBy("id").collect()
    assert [r["id"] for r in back] == ["1_seg_0", "2_seg_0"] and back[0]["metadata"]["k"] == "v" and len(back[0]["embedding"]) == models.DIM
    assert sinks.replace_documents(docs, docs.limit(1)).count() == 2 and sinks.delete_documents(docs, docs.limit(1)).count() == 1
    path = sinks.save_registry(spark.createDataFrame([("a", "ACTIVE"), ("b", "DELETED")], "document_id string, status string"), str(tmp_path / "r"), 1)
    assert spark.read.json(path).count() == 2
    (tmp_path / "reg.json").write_text('[{"document_id": "a", "status": "ACTIVE"}, {"document_id": "b", "status": "DELETED"}]')
    assert loaders.registry(spark, str(tmp_path / "reg.json"), "document_id string, status string").count() == 1


def test_streaming_ingest(spark, tmp_path):
    from larkspine.operators import chunkers

    schema = "document_id string, doc_id long, content string, text string, ts timestamp"
    rows = [("a", 1, "x", "one. two.", None), ("a", 1, "x", "one. two.", None), ("b", 2, "y", "three.", None)]
    spark.createDataFrame(rows, schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = ingest.arrivals(spark, str(tmp_path / "in"), schema)
    q = ingest.ingest(stream, chunkers.strategy("recursive", 50, 0), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_only_texts_without_words_or_refused_ones_fail(spark, tmp_path):
    """Two words whose signed components cancel out are a text like any other."""
    import itertools

    import duckdb

    from larkspine.plans import registry

    words = ["".join(x) for x in itertools.product("abcde", repeat=3)]
    first = models.hash_embedder(words)
    pair = next(f"{a} {b}" for (a, v), (b, w) in itertools.combinations(zip(words, first), 2) if not any(x + y for x, y in zip(v, w)))
    assert not any(models.hash_embedder([pair])[0])
    texts = [pair, "aaa", "", None, " \t\n", "\u00a0", "zz", f"{pair} z", "\u3000 \x0b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["s10_zero_vector"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.execute(registry.SQL["s10_zero_vector"]).fetchall()) and not got[0][1]


def test_a_word_is_hashed_once(monkeypatch):
    import hashlib

    seen, md5 = [], hashlib.md5
    models._component.cache_clear() if hasattr(models, "_component") else None
    monkeypatch.setattr(models.hashlib, "md5", lambda b: seen.append(b) or md5(b))
    got = models.hash_embedder(["Twice twice once", "twice", "", None])
    assert sorted(seen) == [b"once", b"twice"] and [len(v) for v in got] == [models.DIM] * 4
    assert sorted(map(abs, got[1]))[-2:] == [0.0, 1.0] and not any(got[2] + got[3]) and models.hash_embedder([]) == []


@pytest.mark.parametrize(
    "rows",
    [
        [("en", ""), ("en", "abc d"), ("de", "x")],
        [("de", ""), ("en", "abc d")],
        [("de", "abc"), (None, "abc"), ("en", None)],
        [("en", "相关内容：some text"), ("en", "提取的内容"), ("en", "以下是: ```x")],
        [("en", "text\r\u2028"), ("en", "\x01text\x01\u0085"), ("en", "\r\u2029"), ("en", " text \r\n")],
        [("en", "b" * 333 + "a" * 307)],
    ],
    ids=["empty", "empty of another language", "none", "labels", "line ends", "tie"],
)
def test_mean_compression_of_odd_texts_is_that_of_its_sql(spark, tmp_path, rows):
    import duckdb

    from larkspine.plans import registry

    spark.createDataFrame(rows, "lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["r35_mean_compression"](spark, str(tmp_path)).first()[0]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert repr(got) == repr(c.execute(registry.SQL["r35_mean_compression"]).fetchone()[0])


def test_trimming_stops_at_line_ends_above_space(spark):
    for x in ("a \u0085", "a\n\u2028", "\t\u2029", "a \r\n", "\x00 a\x1f"):
        assert one(spark, text.jtrim, x) == x.strip("".join(map(chr, range(33))))


def test_ratio_of_empty_texts(spark):
    hits = spark.createDataFrame([("",), ("abcd",), (None,)], "text string")
    ratios = {r["text"]: r["ratio"] for r in pipelines.compress(hits, F.lit("relevant"), F.col("text"), 0.0).collect()}
    assert str(ratios[""]) == "nan" and ratios["abcd"] == 1.0 and ratios[None] is None
    assert pipelines.compress(hits.where("text = ''"), F.lit("relevant"), F.lit("x")).first()["ratio"] == float("inf")
    assert pipelines.mean_ratio(pipelines.compress(hits.limit(0), F.lit("relevant"), F.col("text"))).first()["mean_ratio"] == 0.0
