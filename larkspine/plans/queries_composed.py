"""Composed operators as queries: hybrid retrievers, rewriting, index writing, failure handling, SQL generation; and SQL for
queries of other modules that builds on theirs."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspine.functions import models, parsers, session, text
from larkspine.operators import chunkers, filters, fusion, incremental, index, rerank, retrieval, text2sql
from larkspine.plans import pipelines
from larkspine.plans.base import SQL, Tables, query, tok_a, tok_b
from larkspine.plans.queries_index import SENTENCES, POSTINGS
from larkspine.plans.queries_retrieval import BOTH_SQL, JACCARD, WEIGHTED, bm25_sql, dense, dense_sql, hits_with_text, sparse, text_queries, top_sql, vector_queries, vectors
from larkspine.sources import loaders, sinks

LAST_LINE = r"regexp_extract(trim({}, E' \t\n\r'), '[^\n]*$')"

# SQL for queries that are registered elsewhere

SQL["a20_html_text"] = r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', ' ', 'g'),
    '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages"""
#: Each slice ends after the last full stop or line end of its characters and the next one, if that leaves more than the overlap.
SQL["b22_parent_slices"] = """WITH RECURSIVE c AS (
        SELECT doc_id, 0 AS chunk_index, 0 AS a, 0 AS e, '' AS chunk, coalesce(text, '') AS text FROM documents WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, chunk_index + 1, e - CASE WHEN chunk_index = 0 THEN 0 ELSE 100 END, b, substring(text, a + 1, b - a), text
        FROM (SELECT doc_id, chunk_index, e, text, a, CASE WHEN a + 800 < length(text) AND m > 100 THEN a + m + 1 ELSE least(a + 800, length(text)) END AS b
              FROM (SELECT *, length(w) - least(coalesce(nullif(instr(reverse(w), chr(10)), 0), 9999), coalesce(nullif(instr(reverse(w), '。'), 0), 9999)) AS m
                    FROM (SELECT doc_id, chunk_index, e, text, e - CASE WHEN chunk_index = 0 THEN 0 ELSE 100 END AS a,
                                 substring(text, e - CASE WHEN chunk_index = 0 THEN 0 ELSE 100 END + 1, 801) AS w FROM c WHERE e < length(text)) x) y) z)
    SELECT doc_id, CAST(chunk_index - 1 AS INTEGER) AS chunk_index, chunk FROM c WHERE chunk_index > 0"""
SQL["b7_semantic_sentences"] = r"""WITH s AS (SELECT doc_id, [y for y in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_extract_all(text, '(?s).{10,}?[。？！\n.?!]|.+')] if y <> ''] AS s FROM documents)
    SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS chunk_index, unnest(s) AS chunk FROM s"""
SQL["r10_highlight_fragments"] = r"""SELECT doc_id, [regexp_replace(y, '(?i)(the|und)', '<em>\1</em>', 'g') for y in [x for x in [substring(text, (i * 100 + 1)::INTEGER, 100) for i in range(0, greatest(ceil(length(text) / 100)::INTEGER, 1))]
    if regexp_matches(x, '(?i)(the|und)')][1:3]] AS fragments FROM documents"""
SQL["r9_multi_match"] = (
    "WITH meta AS (SELECT doc_id, concat_ws(' ', source, lang) AS text FROM documents), a AS (WITH "
    + bm25_sql(None)
    + " SELECT query_id, doc_id, score * 2.0 AS score FROM bm25), b AS (WITH "
    + bm25_sql(None).replace("documents", "meta")
    + """ SELECT query_id, doc_id, score FROM bm25), c AS (SELECT query_id, doc_id, round(max(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score >= 0 QUALIFY rank <= 10"""
)
#: Of what a rating model is shown.
_JACCARD = JACCARD.removeprefix("round(").removesuffix(", 6)").replace("d.text", "(CASE WHEN length(d.text) > 500 THEN substring(d.text, 1, 500) || '...' ELSE d.text END)")
SQL["r27_enhanced_search"] = (
    "WITH "
    + bm25_sql(10)
    + f""", sc AS (SELECT b.query_id, b.doc_id, printf('%.4f', 10 * {_JACCARD})::DOUBLE AS score FROM bm25 b JOIN q ON b.query_id = q.query_id JOIN documents d ON d.doc_id = b.doc_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc) SELECT * FROM r WHERE rank <= 5 AND score >= 0.1"""
)
CHAT = f"SELECT q.query_id, CASE WHEN count(h.doc_id) = 0 THEN '{pipelines.EMPTY_ANSWER}' ELSE any_value({LAST_LINE.format('q.query')}) END AS answer, coalesce(list_sort(list(h.doc_id) FILTER (h.doc_id IS NOT NULL)), []) AS sources FROM q LEFT JOIN {{}} h ON q.query_id = h.query_id GROUP BY 1"
SQL["r40_chat"] = "WITH " + bm25_sql(3) + " " + CHAT.format("bm25")
_GRADE = "CASE WHEN h IN ('CORRECT', 'AMBIGUOUS', 'INCORRECT') THEN h WHEN contains(h, 'CORRECT') AND NOT contains(h, 'INCORRECT') THEN 'CORRECT' WHEN contains(h, 'INCORRECT') OR contains(h, '不相关') THEN 'INCORRECT' ELSE 'AMBIGUOUS' END"
SQL["r37_corrective"] = (
    "WITH "
    + bm25_sql(5)
    + f""", l AS (SELECT b.query_id, max_by(CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END, rank) AS t FROM bm25 b JOIN documents d ON d.doc_id = b.doc_id WHERE rank <= 3 GROUP BY 1),
    h AS (SELECT query_id, upper(trim(string_split({LAST_LINE.format('t')}, '|')[1])) AS h FROM l), g AS (SELECT query_id, {_GRADE} AS grade FROM h)
    SELECT query_id, doc_id, rank, 'retrieved' AS origin FROM bm25 JOIN g USING (query_id) WHERE grade <> 'INCORRECT' UNION ALL SELECT query_id, doc_id, rank, 'rewritten' FROM bm25 JOIN g USING (query_id) WHERE grade = 'AMBIGUOUS'"""
)
_A = LAST_LINE.format("text")
SQL["m2_rewrite"] = f"""WITH a AS (SELECT item_id AS query_id, text AS query, {_A} AS a FROM benchmark)
    SELECT query_id, query, CASE WHEN regexp_replace(upper(a), '[^A-Z_]', '', 'g') IN ('FACTUAL', 'DEFINITION', 'HOW_TO', 'COMPARISON', 'LIST') THEN regexp_replace(upper(a), '[^A-Z_]', '', 'g') ELSE 'INFORMATIONAL' END AS intent,
           0.8::DOUBLE AS confidence, CASE WHEN length(trim(a)) > 3 * length(query) OR length(trim(a)) < 3 THEN query ELSE trim(a) END AS rewritten,
           [x for x in [trim(a)] if x <> '' AND length(x) <= 20] AS keywords FROM a"""
HASHED = """w AS (SELECT id, unnest([x for x in string_split_regex(lower({t}), '\\s+') if x <> '']) AS w FROM {of}),
    v AS (SELECT id, ('0x' || substring(md5(w), 1, 2))::INTEGER % 64 AS dim, sum(CASE WHEN ('0x' || substring(md5(w), 15, 2))::INTEGER >= 128 THEN 1 ELSE -1 END) AS x FROM w GROUP BY 1, 2)"""
UNIT = "SELECT id, dim, round((x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT, 4) AS value FROM v QUALIFY x <> 0"


def components(rows: DataFrame, name: str) -> DataFrame:
    """The components of embeddings that are not zero."""
    each = rows.select(F.col(name).alias("id"), F.posexplode("embedding").alias("dim", "value"))
    return each.where("value <> 0").select("id", "dim", F.round("value", 4).alias("value"))


# Embeddings and their failures


@query("m4_hyde_vectors", f"WITH d AS (SELECT item_id AS id, {_A} AS t FROM benchmark), " + HASHED.format(t="t", of="d") + " " + UNIT)
def hyde_vectors(t: Tables) -> DataFrame:
    return components(pipelines.hyde(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), models.echo_chat, models.hash_embedder), "query_id")


def _picky(texts: list[str]) -> list[list[float]]:
    """An embedder that refuses texts with a z.  It counts words without signs, which can't cancel out, so only a text without words is a zero vector;
    words are parted by what SQL takes for white space."""
    if any("z" in (x or "") for x in texts):
        raise ValueError("refused")
    out = []
    for x in texts:
        v = [0.0] * models.DIM
        for w in re.findall(r"[^\t\n\f\r ]+", x or ""):
            v[zlib.crc32(w.encode()) % models.DIM] += 1.0
        out.append(v)
    return out


@query("s10_zero_vector", "SELECT doc_id, contains(coalesce(text, ''), 'z') OR regexp_matches(coalesce(text, ''), '^\\s*$') AS failed, 64 AS dim FROM documents")
def zero_vector(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", models.embed(_picky, F.col("text"), models.DIM).alias("e"))
    return rows.select("doc_id", models.failed(F.col("e")).alias("failed"), F.size("e").alias("dim"))


@query("s12_failures_by_document", "SELECT lang, count(*) AS total, count(*) FILTER (contains(coalesce(text, ''), 'z')) AS failed FROM documents GROUP BY 1")
def failures(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", models.embed(_picky, F.col("text")).alias("e"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("e").isNull()).alias("failed"))


#: Sentences of whole documents with their neighbours, embedded; of each document the sums of the components over its windows.
CONTEXTS = (
    f"WITH s AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents) x), "
    "c AS (SELECT doc_id * 1000000 + pos AS id, string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t FROM s), "
    + HASHED.format(t="t", of="c")
    + ", u AS (SELECT id, dim, (x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT AS value FROM v QUALIFY x <> 0)"
)


@query("b8_context_embeddings", CONTEXTS + " SELECT id // 1000000 AS doc_id, dim, round(sum(value::DOUBLE), 3) + 0.0 AS total FROM u GROUP BY 1, 2")
def context_embeddings(t: Tables) -> DataFrame:
    rows = chunkers.exploded(t.documents, chunkers.sentences(F.col("text"))).select("doc_id", F.col("chunk_index").alias("pos"), F.col("chunk").alias("sentence"))
    embedded = chunkers.context_windows(rows, 1).select("doc_id", models.embed(models.hash_embedder, F.col("context"), models.DIM).alias("e"))
    each = embedded.select("doc_id", F.posexplode("e").alias("dim", "value")).where("value <> 0")
    return each.groupBy("doc_id", "dim").agg((F.round(F.sum(F.col("value").cast("double")), 3) + 0.0).alias("total"))


# Index classes


@query("s7_index_documents", "SELECT doc_id || '_seg_' || i AS id, doc_id, substring(text, (i * 450 + 1)::INTEGER, 500) AS content, 64 AS dim, length(substring(text, (i * 450 + 1)::INTEGER, 500))::VARCHAR AS segment, lang, i::VARCHAR AS chunk_index FROM (SELECT doc_id, lang, text, unnest(range(0, greatest(ceil((length(text) - 500) / 450.0), 0)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0) x")
def index_rows(t: Tables) -> DataFrame:
    chunks = chunkers.exploded(t.documents, chunkers.slices(F.col("text"), 500, 50))
    rows = sinks.index_documents(t.documents, chunks, models.hash_embedder, F.create_map(F.lit("lang"), F.col("lang")))
    value = lambda k: F.try_element_at("metadata", F.lit(k))
    return rows.select("id", "doc_id", "content", F.size("embedding").alias("dim"), value("segmentLength").alias("segment"), value("lang").alias("lang"), value("chunk_index").alias("chunk_index"))


@query("s2_search_with_filter", "WITH " + dense_sql(5, rows="b.label = 1") + " SELECT query_id, doc_id AS id, score, rank FROM dense WHERE score >= 0.1")
def search_with_filter(t: Tables) -> DataFrame:
    rows = index.ChunkIndex(t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label"))
    return rows.search(vector_queries(t), 5, F.col("label") == 1, 0.1)


@query("s1_index_stats", "SELECT count(*) AS rows, count(DISTINCT vec_id) AS keys FROM embeddings")
def chunk_index_stats(t: Tables) -> DataFrame:
    return index.ChunkIndex(t.embeddings.select(F.col("vec_id").alias("id"), "embedding")).stats()


@query("s6_keyword_index", POSTINGS)
def stored_postings(t: Tables) -> DataFrame:
    return t.keywords().postings()


@query("s19_image_text", "SELECT doc_id, '【图像内容】' || chr(10) || '文件名: ' || source || chr(10) || '描述: ' || lang || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '尺寸: ' || doc_id || 'x' || n_chars || chr(10) || '格式: png' || chr(10) ELSE '' END AS t FROM documents")
def image_text(t: Tables) -> DataFrame:
    width = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    return t.documents.select("doc_id", text.image_index_text(F.col("source"), F.col("lang"), width, F.col("n_chars"), F.lit("png")).alias("t"))


@query("a12_image_blocks", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [lang] ELSE [] END AS images FROM documents")
def image_blocks(t: Tables) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "IMAGE").otherwise("TEXT")
    blocks = F.array(F.struct(kind.alias("type"), F.col("lang").alias("content")), F.struct(F.lit("TEXT").alias("type"), F.col("source").alias("content")))
    return t.documents.select("doc_id", F.transform(text.image_blocks(blocks), lambda b: b["content"]).alias("images"))


@query("a1_mime_type", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'application/pdf' WHEN page_id % 5 = 1 THEN 'image/png' WHEN page_id % 5 = 2 THEN 'application/octet-stream' WHEN coalesce(html, '') = '' THEN NULL WHEN regexp_matches(lower(ltrim(html)), '^<(!doctype html|html)') THEN 'text/html' ELSE 'text/plain' END AS mime FROM pages")
def mime_type(t: Tables) -> DataFrame:
    head = F.when(F.col("page_id") % 5 == 0, F.encode(F.lit("%PDF-1.4"), "UTF-8")).when(F.col("page_id") % 5 == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(F.col("page_id") % 5 == 2, F.unhex(F.lit("00010203")))
    return t.pages.select("page_id", loaders.sniff(F.coalesce(head, F.encode("html", "UTF-8")), F.lit("page.html")).alias("mime"))


# Predicates

M = filters.MetadataFilter


@query("f8_builders", "SELECT doc_id FROM documents WHERE lang = 'de' OR (contains(source, '1') AND lang IN ('en', 'fr') AND lang <> 'fr')")
def builders(t: Tables) -> DataFrame:
    inner = filters.combine("AND", M.contains("source", "1"), M.isin("lang", ["en", "fr"]), M.ne("lang", "fr"))
    return t.documents.where(filters.combine("OR", M.eq("lang", "de"), inner).to_sql()).select("doc_id")


@query("f9_as_column", "SELECT doc_id FROM documents WHERE lang = 'de' OR source LIKE 'src1%'")
def as_column(t: Tables) -> DataFrame:
    return t.documents.where(filters.combine("OR", M.eq("lang", "de"), M().add("source", "STARTS_WITH", "src1")).to_column(F.col)).select("doc_id")


@query("f24_relevant", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 1")
def relevant(t: Tables) -> DataFrame:
    i = F.col("doc_id") % 4
    return t.documents.where(parsers.relevant(F.when(i == 0, "Relevant.").when(i == 1, "it is not relevant").when(i == 2, "相关"))).select("doc_id")


# Retrievers


@query("r22_failing_channel", "WITH " + bm25_sql(20) + ", j AS (SELECT query_id, doc_id, NULL::INTEGER AS dense_rank, rank AS sparse_rank FROM bm25)" + top_sql(WEIGHTED, cols="query_id, doc_id", rank="rank"))
def failing_channel(t: Tables) -> DataFrame:
    broken = lambda queries, k: t.spark.read.parquet(f"{t.sf_dir}/no-such-store")
    return retrieval.HybridRetriever(broken, retrieval.KeywordRetriever(t.keywords()))(text_queries(t), 10)


@query("r41_retriever", BOTH_SQL + top_sql("0.7 / (60 + coalesce(dense_rank, 999)) + 0.3 / (60 + coalesce(sparse_rank, 999))", cols="query_id, doc_id", rank="rank"))
def retriever(t: Tables) -> DataFrame:
    by_vector = lambda queries, k: retrieval.dense(vectors(t), vector_queries(t).join(queries.select("query_id"), "query_id"), k)
    return retrieval.HybridRetriever(by_vector, retrieval.KeywordRetriever(t.keywords()), "RRF_MISSING_RANK")(text_queries(t), 10)


for _name, _score in (("rrf", WEIGHTED), ("dense_only", "coalesce(0.7 / (60 + dense_rank), 0.0)"), ("sparse_only", "coalesce(0.3 / (60 + sparse_rank), 0.0)")):
    _rows = {"rrf": "j", "dense_only": "(SELECT query_id, doc_id, dense_rank, NULL AS sparse_rank FROM j WHERE dense_rank IS NOT NULL)", "sparse_only": "(SELECT query_id, doc_id, NULL AS dense_rank, sparse_rank FROM j WHERE sparse_rank IS NOT NULL)"}[_name]

    @query(f"r12_fuse_{_name}", BOTH_SQL + top_sql(_score, cols="query_id, doc_id", of=f"{_rows} z"))
    def fuse(t: Tables, name: str = _name) -> DataFrame:
        return fusion.fuse(name, dense(t), sparse(t)).select("query_id", "doc_id", "score", "final_rank")


@query(
    "r28_reranked",
    "WITH " + bm25_sql(10) + f""", f AS (SELECT d.text, min(row(b.query_id, b.rank, b.doc_id)) AS p FROM bm25 b JOIN documents d USING (doc_id) GROUP BY 1),
    sc AS (SELECT struct_extract(p, 3) AS doc_id, printf('%.4f', 10 * {_JACCARD})::DOUBLE AS score FROM f d, (SELECT query FROM q ORDER BY query_id LIMIT 1) q)
    SELECT 0::BIGINT AS query_group, doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 5""",
)
def reranked(t: Tables) -> DataFrame:
    queries = text_queries(t).select(F.lit(0).cast("long").alias("query_group"), F.col("query_id").alias("query_pos"), "query_id", "query")
    rate = lambda q, d: F.format_string("score: %.4f", 10 * text.jaccard(text.word_set(q), text.word_set(d)))
    return retrieval.multi_query_reranked(retrieval.KeywordRetriever(t.keywords()), queries, t.documents.select("doc_id", "text"), rate, 5)


@query("r30_few_as_they_are", "WITH " + bm25_sql(4) + " SELECT query_id, doc_id, score, rank AS mmr_rank FROM bm25")
def few(t: Tables) -> DataFrame:
    return rerank.diverse(hits_with_text(t, 4), 5, 0.3)


@query("r39_optimized_chat", "WITH " + bm25_sql(5) + ", k AS (SELECT * FROM bm25) " + CHAT.format("k"))
def optimized(t: Tables) -> DataFrame:
    search = lambda queries, k: retrieval.keyword_search(t.keywords(), queries, 5).join(t.documents.select("doc_id", "text"), "doc_id")
    return pipelines.optimized_chat(text_queries(t), search, models.echo_chat, None)


# Rewriting


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _planner(prompts: list[str]) -> list[str | None]:
    """A stand-in that answers each kind of request in its form, from the query's words; it fails for every fifth length."""
    out: list[str | None] = []
    for p in prompts:
        kind, _, q = (p or "").partition("\n")
        words = q.split()
        if len(q) % 5 == 0:
            out.append(None)
        elif kind == "decompose:":
            out.append("Parts:\n- " + " ".join(words[:3]) + "\n- " + " ".join(words[3:6]))
        elif kind == "broader:":
            out.append("What is known of " + " ".join(words[-2:]))
        else:
            out.append('```json\n{"sortBy": "date", "limit": %d, "query": "%s"}\n```' % (len(words), " ".join(w for w in words[:2] if w.isalnum())))
    return out


WORDS = r"q AS (SELECT item_id AS query_id, text AS query, [x for x in string_split_regex(text, '\s+') if x <> ''] AS w, length(text) % 5 = 0 AS bad FROM benchmark)"
SUBS = "[x for x in [array_to_string(w[1:3], ' '), array_to_string(w[4:6], ' ')] if x <> '' AND x <> query]"
BROAD = "CASE WHEN NOT bad AND NOT contains('What is known of ' || array_to_string(w[-2:], ' '), substring(query, 1, 10)) THEN 'What is known of ' || array_to_string(w[-2:], ' ') END"


@query("m3_expansion", r"SELECT item_id AS query_id, unnest(list_distinct([replace(text, chr(10), ' '), 'about ' || length(text) || ' letters'])) AS q FROM benchmark")
def expansion(t: Tables) -> DataFrame:
    said = F.concat(F.lit("1. "), F.col("query"), F.lit("\n2. about "), F.length("query").cast("string"), F.lit(" letters\n3. no"))
    return questions(t).withColumn("query", F.translate("query", "\n", " ")).select("query_id", F.explode(pipelines.expansions(F.col("query"), said)).alias("q"))


@query("m5_structured", f"WITH {WORDS} SELECT query_id, CASE WHEN bad THEN NULL ELSE 'date' END AS sort_by, 'desc' AS \"order\", CASE WHEN bad THEN 1 ELSE len(w)::INTEGER END AS \"limit\", CASE WHEN bad THEN query ELSE array_to_string([x for x in w[1:2] if regexp_full_match(x, '[\\p{{L}}\\p{{N}}]+')], ' ') END AS rest FROM q")
def structured(t: Tables) -> DataFrame:
    return pipelines.structured(questions(t), _planner).drop("query")


@query("m6_decomposition", f"WITH {WORDS} SELECT query_id, CASE WHEN bad OR len({SUBS}) = 0 THEN [query] ELSE {SUBS} END AS sub_queries FROM q")
def decomposition(t: Tables) -> DataFrame:
    return pipelines.decompose(questions(t), _planner).drop("query")


@query("m7_step_back", f"WITH {WORDS} SELECT query_id, {BROAD} AS broader FROM q")
def step_back(t: Tables) -> DataFrame:
    return pipelines.step_back(questions(t), _planner).drop("query")


@query(
    "m8_comprehensive",
    f"""WITH {WORDS}, a AS (SELECT query_id, query, {BROAD} AS b, CASE WHEN bad OR len({SUBS}) = 0 THEN [query] ELSE {SUBS} END AS s FROM q),
    e AS (SELECT query_id, 0 AS i, query AS x FROM a UNION ALL SELECT query_id, unnest(range(len(s))) + 1, unnest(s) FROM a UNION ALL SELECT query_id, 99, b FROM a WHERE b IS NOT NULL),
    f AS (SELECT query_id, x, min(i) AS i FROM e GROUP BY 1, 2)
    SELECT query_id, any_value(coalesce(b, query)) AS main, list(x ORDER BY i) AS queries FROM f JOIN a USING (query_id) GROUP BY 1""",
)
def comprehensive(t: Tables) -> DataFrame:
    return pipelines.comprehensive(questions(t), _planner).select("query_id", "main", "queries")


@query("m9_generic_rewrite", f"SELECT item_id AS query_id, CASE WHEN length(trim({_A})) < 3 THEN text ELSE trim({_A}) END AS rewritten FROM benchmark")
def generic_rewrite(t: Tables) -> DataFrame:
    return pipelines.generic_rewrite(questions(t), models.echo_chat).drop("query")


def _selector(prompts: list[str]) -> list[str | None]:
    """A stand-in: the question's first word is searched for, its length is the year; the second condition's field is unknown."""
    q = [p.rsplit("\n", 1)[-1] for p in prompts]
    return [f"{parsers.QUERY_LABEL}: {x.split(' ')[0]}\n{parsers.FILTER_LABEL}:\n- year: gt={len(x)}\n- colour: eq=red\n" if "year (number)" in p else None for p, x in zip(prompts, q)]


@query("m10_self_query", f"SELECT item_id AS query_id, string_split({_A}, ' ')[1] AS words, 'year GREATER_THAN ' || length({_A}) AS condition FROM benchmark")
def self_query(t: Tables) -> DataFrame:
    found = pipelines.self_query(questions(t), _selector)
    return found.select("query_id", "words", F.array_join(F.transform("conditions", lambda c: F.concat_ws(" ", c["key"], c["op"], c["value"])), ";").alias("condition"))


@query("m11_image_description", "SELECT page_id, CASE WHEN html IS NULL THEN NULL ELSE 'what is it: ' || strlen(html) || ' bytes' END AS said FROM pages")
def image_description(t: Tables) -> DataFrame:
    return t.pages.select("page_id", models.describe_image(models.size_vision, F.encode("html", "UTF-8"), F.lit("Look.\nwhat is it")).alias("said"))


@query("m13_snippets", "WITH " + bm25_sql(3) + " SELECT query_id, doc_id, trim(substring(text, 5, 40), E' \\t\\n\\r') AS snippet FROM bm25 JOIN documents USING (doc_id) WHERE length(trim(substring(text, 5, 40), E' \\t\\n\\r')) >= 10")
def snippets(t: Tables) -> DataFrame:
    return pipelines.snippets(hits_with_text(t, 3), F.concat(F.lit("提取的内容: "), F.substring("text", 5, 40)))


# SQL from questions


@query("t1_knowledge_items", "SELECT n_nationkey AS id, '字段: nation.' || n_name || chr(10) || '说明: ' || n_regionkey AS field, '术语: ' || n_name || chr(10) || '解释: ' || n_regionkey AS term, '问题: ' || n_name || chr(10) || 'SQL: SELECT 1' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || '说明: x' ELSE '' END AS example FROM nation")
def items(t: Tables) -> DataFrame:
    name, region = F.col("n_name"), F.col("n_regionkey").cast("string")
    return t.nation.select(
        F.col("n_nationkey").alias("id"),
        text2sql.field_item(F.lit("nation"), name, region).alias("field"),
        text2sql.term_item(name, region).alias("term"),
        text2sql.example_item(name, F.lit("SELECT 1"), F.when(F.col("n_nationkey") % 2 == 0, "x")).alias("example"),
    )


@query("t4_cleared", "SELECT n_nationkey AS id, 'TERM' AS type FROM nation WHERE n_nationkey % 2 = 1")
def cleared(t: Tables) -> DataFrame:
    known = t.nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "DDL").otherwise("TERM").alias("type"))
    return text2sql.cleared(known, ("DDL",))


NATIONS = "SELECT n_regionkey, count(*) AS n FROM {} GROUP BY n_regionkey ORDER BY n_regionkey"


@query("t6_execute", "SELECT n_regionkey::VARCHAR AS n_regionkey, count(*)::VARCHAR AS n FROM nation GROUP BY 1")
def execute(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("t6_nation")
    return text2sql.as_table(t.spark, text2sql.execute(t.spark, NATIONS.format("t6_nation")))


@query("t8_repair_and_explain", "SELECT 2 AS attempts, count(DISTINCT n_regionkey) || ' rows of ' || 't8_nation' AS explanation FROM nation")
def repair(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("t8_nation")
    fix = lambda sql, error: sql.replace("t8_nations", "t8_nation") if "t8_nations" in error else sql
    got, said = text2sql.answer(t.spark, NATIONS.format("t8_nations"), fix, lambda sql, r: f"{len(r.rows)} rows of {sql.split(' FROM ')[1].split()[0]}")
    return t.spark.createDataFrame([(got.attempts, said)], "attempts int, explanation string")


#: Statements of a nation, and whether they may and can run: reading ones with literals and WITH, names that are not there, errors,
#: commands, calls into the JVM, files by path, statements that build statements.
JUDGED = (
    ("SELECT n_regionkey FROM t9_nation WHERE n_name = '{}'", True),
    ("SELECT '{};' AS a; ", True),
    ("WITH a AS (SELECT n_nationkey AS k FROM t9_nation WHERE n_name = '{}') SELECT max(k) AS k FROM a", True),
    ("EXPLAIN SELECT count(*) FROM t9_nation WHERE n_name < '{}'", True),
    ("SELECT n_name FROM t9_nation WHERE n_nam = '{}'", False),
    ("SELEC '{}'", False),
    ("SELECT 1 AS a; DROP VIEW t9_nation -- {}", False),
    ("DROP VIEW t9_nation /* {} */", False),
    ("EXPLAIN DROP VIEW t9_nation /* {} */", False),
    ("WITH a AS (SELECT '{}' AS b) INSERT OVERWRITE DIRECTORY '/nowhere' USING json SELECT * FROM a", False),
    ("SELECT * FROM t9_nation WHERE n_name IN (SELECT java_method('java.lang.System', 'getProperty', '{}'))", False),
    ("SELECT * FROM text.`/{}`", False),
    ("EXECUTE IMMEDIATE 'DROP VIEW t9_nation' /* {} */", False),
)
_JUDGED_SQL = ", ".join(f"""('{s.replace("'", "''")}', {str(v).lower()})""" for s, v in JUDGED)


@query("t9_validate", f"SELECT n_nationkey, replace(s, '{{}}', n_name) AS sql, valid FROM nation, (VALUES {_JUDGED_SQL}) v(s, valid)")
def validate(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("t9_nation")
    made = F.explode(F.array(*[F.replace(F.lit(s), F.lit("{}"), F.col("n_name")) for s, _ in JUDGED])).alias("sql")
    return text2sql.validated(t.nation.select("n_nationkey", made)).select("n_nationkey", "sql", F.col("error").isNull().alias("valid"))


def _writer(prompts: list[str]) -> list[str | None]:
    return [f"```sql\nSQL: {'DROP' if len(p.rsplit(chr(10), 1)[-1]) % 2 else 'SELECT'} {len(p)}\n```" for p in prompts]


@query("m12_generate_sql", f"SELECT item_id AS query_id, CASE WHEN length({_A}) % 2 = 0 THEN 'SELECT ' || (length(text) + 4) END AS sql FROM benchmark")
def generate(t: Tables) -> DataFrame:
    asked = questions(t)
    return text2sql.generated(asked, asked.select("query_id", F.lit("ab").alias("context")), _writer)


# Incremental import


@query("i11_replace_chunks", "SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'new' ELSE 'old' END AS chunk FROM documents WHERE doc_id % 4 <> 2")
def replace_chunks(t: Tables) -> DataFrame:
    """Of every four documents one is created, one updated, one deleted and one skipped."""
    key, i = F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id") % 4
    old = t.documents.where(i != 0).select(key, F.lit("old").alias("chunk"))
    fresh = t.documents.where(i != 2).select(key, F.lit("new").alias("chunk"))
    planned = t.documents.select(key, F.when(i == 0, "CREATED").when(i == 1, "UPDATED").when(i == 2, "DELETED").otherwise("SKIPPED").alias("action"))
    return incremental.replace_chunks(old, planned, fresh)


# Functions for spark.sql


@query(
    "u16_session_functions",
    f"SELECT doc_id, md5(array_to_string({tok_a('text')}, ' ')) AS basic, md5(array_to_string(list_sort({tok_b('text')}), ' ')) AS mixed, "
    "CASE WHEN length(text) > 0 THEN greatest(ceil((length(text) - 500) / 400.0), 0)::BIGINT + 1 ELSE 0 END AS slices, "
    "round(ln(1 + 9.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * length(text) / 800.0)), 6) AS term FROM documents",
)
def session_functions(t: Tables) -> DataFrame:
    session.register(t.spark)
    return t.documents.selectExpr(
        "doc_id",
        "md5(array_join(tokens_basic(text), ' ')) AS basic",
        "md5(array_join(array_sort(tokens_mixed(text)), ' ')) AS mixed",
        "CAST(coalesce(size(chunk_slices(text, 500, 100)), 0) AS BIGINT) AS slices",
        "round(bm25_term(2, 1, 10, length(text), 800), 6) AS term",
    )
