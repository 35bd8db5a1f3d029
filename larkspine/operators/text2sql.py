"""Natural language to SQL: a knowledge base, a guard, execution on Spark SQL, and repair by a model.

Statements are planned by Catalyst; errors of analysis come before anything runs and drive the repair.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspine.operators.sqlguard import validate

#: Kinds of knowledge in the order of a context, with their headings.
KINDS = ("DDL", "DESCRIPTION", "TERM", "QSQL")
HEADINGS = {"DDL": "=== 数据库表结构 ===", "DESCRIPTION": "=== 字段说明 ===", "TERM": "=== 业务术语 ===", "QSQL": "=== 查询示例 ==="}
READ_ONLY = r"(?is)^\s*(SELECT|SHOW|DESCRIBE|EXPLAIN)\b"
MOST_ROWS, TIMEOUT_S, ATTEMPTS = 100, 30, 3


def guard(sql: Column) -> Column:
    """Whether statements are single and read-only by their first word: a screen for columns of statements; what runs is judged by its plan."""
    body = F.regexp_replace(sql, r";\s*$", "")
    return F.coalesce(body.rlike(READ_ONLY) & ~body.contains(";"), F.lit(False))


def limited(sql: Column, most: int = MOST_ROWS) -> Column:
    """A SELECT without LIMIT gets one; a closing semicolon goes."""
    body = F.regexp_replace(F.rtrim(sql), r";+\s*$", "")
    return F.when(F.upper(body).startswith("SELECT") & ~F.upper(body).contains("LIMIT"), F.concat(body, F.lit(f" LIMIT {most}"))).otherwise(body)


def stringified(df: DataFrame) -> DataFrame:
    """Every value as a string, null as ``NULL``."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) for c in df.columns])


def validated(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """The rows with ``error``: why the statement may not or cannot run, null if it can.  Statements are judged one by one on the driver, where
    Spark's parser is; only that column goes through it."""
    spark = statements.sparkSession
    judged = [(r[0], validate(spark, r[0])) for r in statements.select(sql).where(F.col(sql).isNotNull()).distinct().toLocalIterator()]
    return statements.join(spark.createDataFrame(judged, f"{sql} string, error string"), sql, "left")


@dataclass
class SqlResult:
    sql: str
    columns: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    error: str | None = None
    attempts: int = 1


def execute(spark: SparkSession, sql: str, most: int = MOST_ROWS, timeout_s: float = TIMEOUT_S) -> SqlResult:
    """Runs one statement that ``sqlguard`` allows; at most ``most`` rows; jobs are cancelled after ``timeout_s``."""
    if why := validate(spark, sql):
        return SqlResult(sql, error=why)
    tag = f"text2sql-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    timer = threading.Timer(timeout_s, lambda: sc.cancelJobsWithTag(tag))
    try:
        df = stringified(spark.sql(sql)).limit(most)
        sc.addJobTag(tag)
        timer.start()
        rows = [list(r) for r in df.collect()]
    except Exception as e:  # what Spark raises is the result here: it goes to the repair
        return SqlResult(sql, error=f"{type(e).__name__}: {e}")
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    return SqlResult(sql, df.columns, rows)


def run_with_repair(spark: SparkSession, sql: str, fix: Callable[[str, str], str], attempts: int = ATTEMPTS) -> SqlResult:
    """Executes; an error goes with the statement to ``fix``, whose answer is tried next."""
    got = SqlResult(sql)
    for n in range(1, attempts + 1):
        got = execute(spark, sql)
        got.attempts = n
        if got.error is None:
            break
        sql = fix(sql, got.error)
    return got


def ddl_item(table: Column, ddl: Column, description: Column) -> Column:
    return F.concat(F.lit("表名: "), table, F.lit("\n"), ddl, F.when(description.isNotNull(), F.concat(F.lit("\n说明: "), description)).otherwise(""))


def field_item(table: Column, field: Column, description: Column) -> Column:
    return F.concat(F.lit("字段: "), table, F.lit("."), field, F.lit("\n说明: "), description)


def term_item(term: Column, explanation: Column) -> Column:
    return F.concat(F.lit("术语: "), term, F.lit("\n解释: "), explanation)


def example_item(question: Column, sql: Column, description: Column) -> Column:
    return F.concat(F.lit("问题: "), question, F.lit("\nSQL: "), sql, F.when(description.isNotNull(), F.concat(F.lit("\n说明: "), description)).otherwise(""))


def cleared(items: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The knowledge without the items of these kinds."""
    return items.where(~F.col("type").isin(*kinds))


def generated(questions: DataFrame, contexts: DataFrame, model) -> DataFrame:
    """query_id, sql: the statement that a model writes for (query_id, query) and its context, without fences and label; null if it is not
    a single read-only statement."""
    from larkspine.functions.models import chat
    from larkspine.functions.parsers import sql_of

    prompt = F.concat_ws("\n\n", F.coalesce("context", F.lit("")), F.col("query"))
    asked = questions.join(contexts, "query_id", "left").withColumn("sql", sql_of(chat(model, prompt)))
    return asked.select("query_id", F.when(guard(F.col("sql")), F.col("sql")).alias("sql"))


def answer(spark: SparkSession, sql: str, fix: Callable[[str, str], str], explain: Callable[[str, SqlResult], str], attempts: int = ATTEMPTS) -> tuple[SqlResult, str | None]:
    """run_with_repair(), and after success what ``explain`` says of the statement and its rows."""
    got = run_with_repair(spark, sql, fix, attempts)
    return got, explain(got.sql, got) if got.error is None else None


def as_table(spark: SparkSession, result: SqlResult) -> DataFrame:
    """A result's rows, all strings."""
    return spark.createDataFrame(result.rows, ", ".join(f"`{c}` string" for c in result.columns))


def context(items: DataFrame) -> DataFrame:
    """One row per query: contents by kind in their order under headings, each followed by a blank line, trimmed.
    Items: query_id, type, position, content."""
    order = F.lit(len(KINDS))
    head = F.lit("")
    for i, k in enumerate(KINDS):
        order = F.when(F.col("type") == k, i).otherwise(order)
        head = F.when(F.col("type") == k, HEADINGS[k]).otherwise(head)
    parts = items.groupBy("query_id", order.alias("o"), head.alias("h")).agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("c"))
    text = F.concat(F.col("h"), F.lit("\n"), F.array_join(F.transform("c", lambda x: F.concat(x["content"], F.lit("\n\n"))), ""))
    whole = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", text.alias("t")))).alias("s"))
    return whole.select("query_id", F.regexp_replace(F.array_join(F.transform("s", lambda x: x["t"]), ""), r"\s+$", "").alias("context"))


def kind_counts(items: DataFrame) -> DataFrame:
    """type, n for every kind, also those without items, and TOTAL."""
    kinds = items.sparkSession.createDataFrame([(k,) for k in KINDS], "type string")
    n = kinds.join(items.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))
    return n.rollup("type").agg(F.sum("n").alias("n")).select(F.coalesce("type", F.lit("TOTAL")).alias("type"), "n")
