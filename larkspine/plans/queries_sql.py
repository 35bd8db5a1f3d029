"""SQL over the relational tables, and the natural-language-to-SQL operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspine.operators import text2sql
from larkspine.plans.base import Tables, query
from larkspine.sources import loaders


def _sql(name: str, names: list[str], text: str, duck: str | None = None) -> None:
    """A statement that Spark SQL and DuckDB both understand; the tables are those named."""

    @query(name, duck or text)
    def run(t: Tables) -> DataFrame:
        session = t.spark.newSession()
        session.conf.set("spark.sql.session.timeZone", "UTC")
        loaders.tables(session, t.sf_dir, names)
        return session.sql(text)


_sql("t10_filter", ["customer"], "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
_sql("g14_group_count", ["customer"], "SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY c_nationkey")
_sql("j10_join", ["customer", "orders"], "SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000")
_sql("t10_recent_days", ["orders"], "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-25 00:00:00' AND o_orderdate < TIMESTAMP '1998-08-01 00:00:00'")
_sql(
    "t10_revenue_by_nation",
    ["customer", "orders", "nation", "region"],
    "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
)
_sql(
    "t10_pricing_summary",
    ["lineitem"],
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
)
_sql("g10_rollup", ["part"], "SELECT coalesce(p_brand, 'TOTAL') AS p_brand, count(*) AS n FROM part GROUP BY ROLLUP (p_brand)")
_sql("u4_difference", ["documents", "labels"], "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
_sql("g13_distinct_texts", ["documents"], "SELECT count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents")
_sql("g6_min_max", ["lineitem"], "SELECT l_suppkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_suppkey")


@query("dedupe_by_hash", "SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedupe(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("t7_stringified", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, coalesce(nullif(s_nationkey, 3)::VARCHAR, 'NULL') AS s_nationkey FROM supplier")
def stringified(t: Tables) -> DataFrame:
    return text2sql.stringified(t.supplier.select("s_suppkey", "s_name", F.nullif("s_nationkey", F.lit(3)).alias("s_nationkey")))


STATEMENTS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'SELECT ' || doc_id::VARCHAR || ';' WHEN 1 THEN 'drop table x' WHEN 2 THEN 'WITH a AS (SELECT 1) SELECT * FROM a' WHEN 3 THEN 'select 1; delete from t' ELSE 'SHOW TABLES' END AS s FROM documents"


def statements(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    s = F.when(k == 0, F.concat(F.lit("SELECT "), F.col("doc_id").cast("string"), F.lit(";"))).when(k == 1, "drop table x").when(k == 2, "WITH a AS (SELECT 1) SELECT * FROM a").when(k == 3, "select 1; delete from t").otherwise("SHOW TABLES")
    return t.documents.select("doc_id", s.alias("s"))


@query("t5_sql_guard", f"SELECT doc_id, doc_id % 5 IN (0, 4) AS allowed FROM ({STATEMENTS}) x")
def guard(t: Tables) -> DataFrame:
    return statements(t).select("doc_id", text2sql.guard(F.col("s")).alias("allowed"))


@query("l6_limit_injection", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'SELECT ' || doc_id::VARCHAR || ' LIMIT 100' WHEN 3 THEN s || ' LIMIT 100' ELSE s END AS s FROM ({STATEMENTS}) x")
def limited(t: Tables) -> DataFrame:
    return statements(t).select("doc_id", text2sql.limited(F.col("s")).alias("s"))


@query("l5_row_cap", "SELECT count(*) AS n FROM (SELECT * FROM documents LIMIT 100) x")
def row_cap(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").limit(text2sql.MOST_ROWS).agg(F.count(F.lit(1)).alias("n"))


@query("l3_structured_sort", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def structured_sort(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)


KIND = "CASE item_id % 3 WHEN 0 THEN 'DDL' WHEN 1 THEN 'DESCRIPTION' ELSE 'QSQL' END"


def items(t: Tables) -> DataFrame:
    k = F.when(F.col("item_id") % 3 == 0, "DDL").when(F.col("item_id") % 3 == 1, "DESCRIPTION").otherwise("QSQL")
    return t.benchmark.select((F.floor(F.col("item_id") / 10)).alias("query_id"), k.alias("type"), F.col("item_id").alias("position"), F.col("text").alias("content"))


@query("t1_ddl_knowledge", "SELECT p_partkey, '表名: ' || p_name || chr(10) || p_brand || chr(10) || '说明: ' || p_type AS content FROM part")
def ddl(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text2sql.ddl_item(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("content"))


@query(
    "t3_context",
    f"""WITH i AS (SELECT item_id // 10 AS query_id, {KIND} AS type, item_id AS position, text AS content FROM benchmark),
    p AS (SELECT query_id, type, CASE type WHEN 'DDL' THEN 0 WHEN 'DESCRIPTION' THEN 1 ELSE 3 END AS o,
          CASE type WHEN 'DDL' THEN '{text2sql.HEADINGS['DDL']}' WHEN 'DESCRIPTION' THEN '{text2sql.HEADINGS['DESCRIPTION']}' ELSE '{text2sql.HEADINGS['QSQL']}' END || chr(10) || string_agg(content || chr(10) || chr(10), '' ORDER BY position) AS t FROM i GROUP BY 1, 2)
    SELECT query_id, regexp_replace(string_agg(t, '' ORDER BY o), '\\s+$', '') AS context FROM p GROUP BY 1""",
)
def context(t: Tables) -> DataFrame:
    return text2sql.context(items(t))


@query("t4_kind_counts", f"WITH k AS (SELECT unnest(['DDL', 'DESCRIPTION', 'TERM', 'QSQL']) AS type), i AS (SELECT {KIND} AS type FROM benchmark), n AS (SELECT k.type, count(i.type) AS n FROM k LEFT JOIN i ON k.type = i.type GROUP BY 1) SELECT type, n FROM n UNION ALL SELECT 'TOTAL', sum(n)::BIGINT FROM n")
def kind_counts(t: Tables) -> DataFrame:
    return text2sql.kind_counts(items(t))


@query("s18_upload_report", "SELECT count(*) AS total, count(*) FILTER (doc_id % 7 <> 0) AS succeeded, count(*) FILTER (doc_id % 7 = 0) AS failed FROM documents")
def upload(t: Tables) -> DataFrame:
    from larkspine.sources.sinks import upload_report

    rows = t.documents.select(F.col("source").alias("filename"), F.when(F.col("doc_id") % 7 == 0, "bad").alias("error"))
    return upload_report(rows).select("total", "succeeded", "failed")
