"""Scalar functions, parsers, predicates and loaders as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspine.functions import parsers, text
from larkspine.operators import filters
from larkspine.plans import pipelines
from larkspine.plans.base import Tables, query, tok_a, tok_b, word_set
from larkspine.sources import loaders

URL_NAME = "regexp_replace(url, '^.*/', '')"


def _name() -> Column:
    return F.regexp_replace("url", "^.*/", "")


# Predicates over a metadata map of each document; toxic and quality are missing where there is no label


META_SQL = "m AS (SELECT d.doc_id, lang, source, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic, d.n_chars::VARCHAR AS n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def meta(t: Tables) -> DataFrame:
    keys = ("lang", "source", "quality", "toxic", "n_chars")
    rows = t.documents.join(t.labels, "doc_id", "left")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys])
    return rows.select("doc_id", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("meta"))


M = filters.MetadataFilter


def _c(key: str, op: str, value: str | None = None, values: list[str] | None = None) -> filters.MetadataFilter:
    return M(parts=[filters.Condition(key, op, value, values)])


#: Name, filter, the same in SQL.
FILTERS = [
    ("f1_equals", _c("quality", "EQUALS", "1"), "coalesce(quality = '1', false)"),
    ("f2_not_equals", _c("quality", "NOT_EQUALS", "1"), "quality IS DISTINCT FROM '1'"),
    ("f3_text_ops", filters.combine("OR", M.contains("source", "c1"), _c("source", "STARTS_WITH", "src2"), _c("source", "ENDS_WITH", "5")), "contains(source, 'c1') OR starts_with(source, 'src2') OR ends_with(source, '5')"),
    ("f4_exists", _c("toxic", "EXISTS"), "toxic IS NOT NULL"),
    ("f5_in", M.isin("lang", ["de", "fr"]), "coalesce(lang IN ('de', 'fr'), false)"),
    ("f6_greater_numeric", _c("n_chars", "GREATER_THAN", "900"), "coalesce(n_chars::DOUBLE > 900, false)"),
    ("f6_less_string", _c("source", "LESS_THAN", "src2"), "source < 'src2'"),
    ("f7_and_or", filters.combine("AND", M.eq("lang", "en"), filters.combine("OR", M.eq("toxic", "1"), M.eq("quality", "0"))), "lang = 'en' AND (coalesce(toxic = '1', false) OR coalesce(quality = '0', false))"),
    ("f10_flattened", filters.combine("AND", M.eq("lang", "en"), filters.combine("OR", M.eq("toxic", "1"), M.eq("quality", "0")), flat=True), "lang = 'en' AND coalesce(toxic = '1', false) AND coalesce(quality = '0', false)"),
    ("f11_time_range", filters.time_range("500", "1500", "n_chars"), "n_chars::DOUBLE > 500 AND n_chars::DOUBLE < 1500"),
    ("f12_any_tag", filters.has_any_tag(["rc1", "c7"], "source"), "contains(source, 'rc1') OR contains(source, 'c7')"),
    ("f12_all_tags", filters.has_all_tags(["rc1", "7"], "source"), "contains(source, 'rc1') AND contains(source, '7')"),
    ("f13_authors", M("OR", [filters.Condition("source", "EQUALS", s) for s in ("src1", "src2")]), "source IN ('src1', 'src2')"),
    ("f14_business", filters.business_query(lang="en", quality="1", toxic=None), "lang = 'en' AND coalesce(quality = '1', false)"),
    ("f19_equality_conjunction", filters.business_query(lang="fr", source="src3"), "lang = 'fr' AND source = 'src3'"),
    ("f20_term_post_filter", M.eq("source", "src5"), "source = 'src5'"),
    ("f21_endpoint_filter", filters.business_query(source="src0", lang="de"), "source = 'src0' AND lang = 'de'"),
]
for _n, _f, _sql in FILTERS:

    @query(_n, f"WITH {META_SQL} SELECT doc_id FROM m WHERE {_sql}")
    def filtered(t: Tables, f=_f) -> DataFrame:
        rows = meta(t)
        return rows.where(f.to_column(lambda k: F.try_element_at(rows["meta"], F.lit(k)))).select("doc_id")


@query("f15_sql_where", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def sql_where(t: Tables) -> DataFrame:
    return t.documents.where(filters.combine("AND", M.eq("lang", "en"), M.isin("source", ["src1", "src2"])).to_sql()).select("doc_id")


ANSWER = "'语义查询: papers ' || doc_id::VARCHAR || chr(10) || '过滤条件:' || chr(10) || '- year: gt=20' || (doc_id % 30)::VARCHAR || chr(10) || '- lang: eq=' || lang"


@query(
    "f16_self_query",
    "SELECT doc_id, 'papers ' || doc_id::VARCHAR AS q, unnest(['year', 'lang']) AS key, unnest(['GREATER_THAN', 'EQUALS']) AS op, unnest(['20' || (doc_id % 30)::VARCHAR, lang]) AS value FROM documents",
)
def self_query(t: Tables) -> DataFrame:
    a = F.concat(F.lit("语义查询: papers "), F.col("doc_id").cast("string"), F.lit("\n过滤条件:\n- year: gt=20"), (F.col("doc_id") % 30).cast("string"), F.lit("\n- lang: eq="), F.col("lang"))
    got = t.documents.select("doc_id", parsers.self_query(a).alias("p"))
    return got.select("doc_id", F.col("p.query").alias("q"), F.explode("p.conditions").alias("c")).select("doc_id", "q", "c.key", "c.op", "c.value")


@query("f23_hash_and_prefix", "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1') AND md5(text) < '8'")
def hash_prefix(t: Tables) -> DataFrame:
    return t.documents.where(F.col("source").startswith("src1") & (F.md5("text") < "8")).select("doc_id", "source")


# Loaders


@query("a5_from_text", r"SELECT text AS content, source AS filename, strlen(text)::BIGINT AS file_size FROM documents WHERE regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') <> ''")
def from_text(t: Tables) -> DataFrame:
    return loaders.from_text(t.documents, "text", "source")


EXT = "CASE WHEN contains({0}, '.') THEN lower(string_split({0}, '.')[-1]) ELSE 'unknown' END"


@query("a6_is_text", f"SELECT page_id, ({EXT.format(URL_NAME)}) IN ({', '.join(repr(x) for x in text.TEXT_EXTENSIONS)}) AS is_text FROM pages")
def is_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.is_text(F.lit(None).cast("string"), _name()).alias("is_text"))


@query("a7_route", f"SELECT page_id, CASE ({EXT.format(URL_NAME)}) WHEN 'pdf' THEN 'pdf' WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'text' WHEN 'json' THEN 'text' WHEN 'xml' THEN 'text' WHEN 'csv' THEN 'text' ELSE 'generic' END AS route FROM pages")
def route(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.route(_name()).alias("route"))


@query("a11_full_text", r"SELECT conv_id, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS full_text FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user') x GROUP BY 1")
def full_text(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", "text").distinct()
    blocks = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda x: F.struct(F.when(x["role"] == "user", "TEXT").otherwise("IMAGE").alias("type"), x["text"].alias("content"))).alias("b"))
    return blocks.where(F.exists("b", lambda x: x["type"] == "TEXT")).select("conv_id", text.full_text(F.col("b")).alias("full_text"))


@query("a13_filename_metadata", f"SELECT page_id, {EXT.format('url')} AS ext, nullif(regexp_extract(url, '20\\d{{2}}'), '') AS year, nullif(regexp_extract(url, 'Q[1-4]'), '') AS quarter FROM pages")
def filename(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.filename_metadata(F.col("url")).alias("m")).select("page_id", "m.*")


@query("a15_table_scan", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def scan(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_name", "s_nationkey")


@query("a17_embedding_shape", "SELECT doc_id, 64 AS dim FROM documents")
def embedding(t: Tables) -> DataFrame:
    from larkspine.functions.models import embed, hash_embedder

    return t.documents.select("doc_id", F.size(embed(hash_embedder, F.col("text"))).alias("dim"))


@query("a18_preview", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || '...' ELSE text END AS preview FROM documents")
def preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", loaders.preview(F.col("text")).alias("preview"))


@query("a20_html_text")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", loaders.html_text(F.col("html")).alias("text"))


# Text functions


@query("r4_tokenizer_basic", f"SELECT doc_id, len({tok_a('text')}) AS n, md5(array_to_string({tok_a('text')}, ' ')) AS h FROM documents")
def tokenizer_a(t: Tables) -> DataFrame:
    k = text.tokens_basic(F.col("text"))
    return t.documents.select("doc_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(k, " ")).alias("h"))


@query("r5_tokenizer_mixed", f"SELECT doc_id, len({tok_b('text')}) AS n, md5(array_to_string(list_sort({tok_b('text')}), ' ')) AS h FROM documents")
def tokenizer_b(t: Tables) -> DataFrame:
    k = text.tokens_mixed(F.col("text"))
    return t.documents.select("doc_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(k), " ")).alias("h"))


@query("r10_highlight_fragments")
def highlight(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.highlight(F.col("text"), ["the", "und"]).alias("fragments"))


@query("r11_matched_terms", "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\b[Tt]he\\b'))) AS terms FROM documents")
def matched(t: Tables) -> DataFrame:
    marked = F.regexp_replace("text", r"\b([Tt]he)\b", "<em>$1</em>")
    return t.documents.select("doc_id", F.array_sort(text.matched_terms(marked)).alias("terms"))


@query("x1_truncate", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END AS short FROM documents")
def truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncate(F.col("text"), 300).alias("short"))


TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


FENCED = r"regexp_replace('```text' || chr(10) || text || chr(10) || '```', '```\w*\n?', '', 'g')"


@query("x2_clean_extract", f"SELECT doc_id, {TRIM.format(FENCED)} AS clean FROM documents")
def clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", parsers.clean_extract(F.concat(F.lit("相关内容: ```text\n"), F.col("text"), F.lit("\n```"))).alias("clean"))


@query("x3_strip_sql", "SELECT doc_id, 'SELECT ' || doc_id::VARCHAR AS sql FROM documents")
def strip_sql(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", parsers.sql_of(F.concat(F.lit("```sql\nSQL: SELECT "), F.col("doc_id").cast("string"), F.lit("\n```"))).alias("sql"))


@query("x4_structured_json", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'date' END AS sort_by, CASE WHEN doc_id % 2 = 0 THEN 'asc' ELSE 'desc' END AS ord, CAST(CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 1 END AS INTEGER) AS lim FROM documents")
def structured(t: Tables) -> DataFrame:
    a = F.when(F.col("doc_id") % 2 == 0, '```json\n{"sortBy": "date", "order": "ASC", "limit": 7}\n```').otherwise('{"sortBy": "color"}')
    return t.documents.select("doc_id", parsers.structured(a).alias("s")).select("doc_id", "s.sort_by", F.col("s.order").alias("ord"), F.col("s.limit").alias("lim"))


@query("x5_variations", "SELECT doc_id, 'variation ' || doc_id::VARCHAR AS v FROM documents")
def variations(t: Tables) -> DataFrame:
    a = F.concat(F.lit("1. variation "), F.col("doc_id").cast("string"), F.lit("\n2) no\n"))
    return t.documents.select("doc_id", F.explode(parsers.variations(a)).alias("v"))


@query("x6_bullets", "SELECT doc_id, unnest(['part one', 'part ' || doc_id::VARCHAR]) AS b FROM documents")
def bullets(t: Tables) -> DataFrame:
    a = F.concat(F.lit("intro\n- part one\n• part "), F.col("doc_id").cast("string"), F.lit("\n- whole"))
    return t.documents.select("doc_id", F.explode(parsers.bullets(a, F.lit("whole"))).alias("b"))


@query("x7_keywords", "SELECT doc_id, lang AS k FROM documents")
def keywords(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(parsers.keywords(F.concat(F.col("lang"), F.lit("\na line that is longer than twenty\n")))).alias("k"))


@query("x8_intent", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'HOW_TO' WHEN 1 THEN 'LIST' ELSE 'INFORMATIONAL' END AS intent FROM documents")
def intent(t: Tables) -> DataFrame:
    a = F.when(F.col("doc_id") % 3 == 0, " how_to. ").when(F.col("doc_id") % 3 == 1, "LIST\n").otherwise("something else")
    return t.documents.select("doc_id", parsers.intent(a).alias("intent"))


@query("x9_rewrite_guard", "SELECT doc_id, CASE WHEN length(source || source || lang) > 2.2 * length(source) THEN source ELSE source || source || lang END AS q FROM documents")
def rewrite_guard(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", parsers.rewrite_guard(F.col("source"), F.concat("source", "source", "lang"), most=2.2).alias("q"))


@query("x10_step_back", "SELECT doc_id, CASE WHEN lang <> 'en' THEN 'what is ' || lang END AS q FROM documents")
def step_back(t: Tables) -> DataFrame:
    a = F.when(F.col("lang") != "en", F.concat(F.lit("what is "), F.col("lang"))).otherwise(F.concat(F.lit("see "), F.col("source"), F.lit(" of a longer question")))
    return t.documents.select("doc_id", parsers.step_back_guard(F.concat("source", F.lit(" of a longer question")), a).alias("q"))


@query("x11_similar_drop", f"SELECT doc_id, len(list_intersect({word_set('text')}, ['the', 'and', 'of', 'und', 'de'])) / len(list_distinct(list_concat({word_set('text')}, ['the', 'and', 'of', 'und', 'de']))) <= 0.02 AS kept FROM documents")
def similar(t: Tables) -> DataFrame:
    kept = parsers.drop_similar(F.lit("the and of und de"), F.array("text"), 0.02)
    return t.documents.select("doc_id", (F.size(kept) > 0).alias("kept"))


@query("x12_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("x13_document_ids", "SELECT doc_id, source AS by_path, md5(text) AS by_hash FROM documents")
def ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.document_id("PATH", F.col("source"), F.col("text")).alias("by_path"), text.document_id("CONTENT_HASH", F.col("source"), F.col("text")).alias("by_hash"))


@query("x15_math", "SELECT doc_id, round(ln(1 + n_chars), 6) AS a, round(sqrt(n_chars), 6) AS b, CAST(ceil(n_chars / 7.0) AS BIGINT) AS c, CAST(least(10, greatest(0, n_chars - 500)) AS BIGINT) AS d FROM documents")
def maths(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.documents.select("doc_id", F.round(F.log(1 + n), 6).alias("a"), F.round(F.sqrt(n), 6).alias("b"), F.ceil(n / 7.0).cast("long").alias("c"), F.least(F.lit(10), F.greatest(F.lit(0), n - 500)).cast("long").alias("d"))


@query("x17_map_flatten", "SELECT doc_id, k, v FROM (SELECT doc_id, unnest(['lang', 'source']) AS k, unnest([lang, nullif(source, 'src0')]) AS v FROM documents) x WHERE v IS NOT NULL")
def flatten(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.when(F.col("source") == "src0", "").otherwise(F.col("source")))
    return t.documents.select("doc_id", F.explode(text.drop_empty(m)).alias("k", "v"))


@query("x18_metadata_json", """SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '"}' AS j FROM documents""")
def to_json(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.metadata_json(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("j"))


@query("x19_base64", "SELECT page_id, base64(encode(html)) AS b FROM pages")
def b64(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_replace(F.base64(F.encode("html", "UTF-8")), "[\r\n]", "").alias("b"))


@query("x20_percentage", "SELECT label, printf('%.2f%%', 100.0 * count(*) / (SELECT count(*) FROM embeddings)) AS share FROM embeddings GROUP BY 1")
def percentage(t: Tables) -> DataFrame:
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n"))
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n)).select("label", text.percentage(F.col("c") / F.col("n")).alias("share"))


@query("r24_rating", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN least(10.0, (doc_id % 17)::DOUBLE) WHEN 1 THEN 8.0 WHEN 2 THEN 2.0 ELSE 5.0 END AS score FROM documents")
def rating(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    a = F.when(i % 4 == 0, F.concat(F.lit("score: "), (i % 17).cast("string"))).when(i % 4 == 1, "highly relevant").when(i % 4 == 2, "irrelevant").otherwise("no idea")
    return t.documents.select("doc_id", parsers.rating(a).alias("score"))


@query("r38_grade", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'INCORRECT' ELSE 'AMBIGUOUS' END AS grade, CASE doc_id % 4 WHEN 0 THEN lang WHEN 2 THEN 'x|y' ELSE '' END AS reason FROM documents")
def grade(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    a = F.when(i % 4 == 0, F.concat(F.lit("correct | "), F.col("lang"))).when(i % 4 == 1, "it is INCORRECT").when(i % 4 == 2, "unsure|x|y").otherwise("unclear")
    return t.documents.select("doc_id", parsers.grade(a).alias("g")).select("doc_id", "g.*")


@query("r35_mean_compression", "SELECT round(avg(length(regexp_replace(translate(text, '` ' || chr(10) || chr(9) || 'aeiou', '____'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) / length(text)), 6) AS mean_ratio FROM documents WHERE lang = 'en'")
def mean_compression(t: Tables) -> DataFrame:
    judge = F.when(F.col("lang") == "en", "relevant").otherwise("irrelevant")
    # Label and fence are the answer's; a label at the start of a text is its own, and stays.
    answer = F.concat(F.lit("相关内容: ```\n"), F.translate("text", "` \n\taeiou", "____"), F.lit("```"))
    done = pipelines.compress(t.documents, judge, answer, 0.0)
    # DuckDB rounds the product in binary, Spark's round at 6 places the decimal digits: 0.5203125 becomes 0.520312 and 0.520313.
    return pipelines.mean_ratio(done, None).select((F.round(F.col("mean_ratio") * 1e6) / 1e6).alias("mean_ratio"))


@query("r36_embedding_filter", "SELECT b.vec_id FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND round(list_sum([z[1]::DOUBLE * z[2]::DOUBLE for z in list_zip(a.embedding, b.embedding)]) / (sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in a.embedding])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in b.embedding]))), 6) >= 0.1")
def embedding_filter(t: Tables) -> DataFrame:
    from larkspine.functions.vector import cosine

    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q)).where(F.round(cosine(F.col("embedding"), F.col("q")), 6) >= 0.1).select("vec_id")


@query("u5_query_union", "SELECT doc_id, unnest(list_distinct([source, lang, source, 'general'])) AS q FROM documents")
def query_union(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(pipelines.all_queries(F.col("source"), F.array("lang", "source"), F.lit("general"))).alias("q"))


# Pipelines with local stand-ins for models


@query("m2_rewrite")
def rewrite(t: Tables) -> DataFrame:
    from larkspine.functions.models import echo_chat

    return pipelines.rewrite(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), echo_chat)


@query("m4_hyde")
def hyde(t: Tables) -> DataFrame:
    from larkspine.functions.models import echo_chat, hash_embedder

    return pipelines.hyde(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), echo_chat, hash_embedder).select("query_id", F.size("embedding").alias("dim"))


@query("r40_chat")
def chat(t: Tables) -> DataFrame:
    from larkspine.functions.models import echo_chat
    from larkspine.plans.queries_retrieval import hits_with_text, text_queries

    return pipelines.answer(text_queries(t), hits_with_text(t, 3), echo_chat)


@query("r37_corrective")
def corrective(t: Tables) -> DataFrame:
    from larkspine.functions.models import echo_chat
    from larkspine.plans.queries_retrieval import hits_with_text, text_queries

    hits = hits_with_text(t, 5)
    grades = pipelines.assess(text_queries(t), hits, echo_chat)
    return pipelines.corrective(text_queries(t), hits, grades, hits, hits.limit(0)).select("query_id", "doc_id", "rank", "origin")
