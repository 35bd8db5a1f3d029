"""The guard judges plans and runs nothing."""

import pytest

from larkspine.operators import sqlguard, text2sql

ALLOWED = [
    "SELECT id FROM guarded",
    "SELECT 'a;b' AS x;",
    "WITH a AS (SELECT 1 AS x) SELECT * FROM a",
    "/* first */ -- then\nSELECT id, count(*) AS n FROM guarded GROUP BY CUBE (id) HAVING count(*) > 0 ORDER BY n LIMIT 3 OFFSET 1",
    "SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS r FROM guarded a LEFT JOIN guarded b USING (id)",
    "SELECT sum(id) OVER w AS s FROM guarded WINDOW w AS (ORDER BY id)",
    "SELECT * FROM (SELECT id, 1 AS k FROM guarded) PIVOT (sum(id) FOR k IN (1, 2))",
    "(SELECT 1 AS a) UNION ALL (SELECT 2) EXCEPT SELECT 3",
    "SELECT * FROM guarded LATERAL VIEW explode(array(1)) e AS x",
    "SELECT (SELECT max(id) FROM guarded) + 1 AS a WHERE EXISTS (SELECT 1 FROM guarded)",
    "FROM guarded |> WHERE id > 1 |> AGGREGATE count(*) AS n",
    "VALUES (1), (2)",
    "TABLE guarded",
    "SELECT * FROM range(3)",
    "SHOW TABLES",
    "SHOW DATABASES",
    "DESCRIBE guarded",
    "DESCRIBE FUNCTION abs",
    "EXPLAIN EXTENDED SELECT 1",
]
REFUSED = [
    "DROP TABLE guarded_table",
    "EXPLAIN DROP TABLE guarded_table",
    "SELECT 1; DROP TABLE guarded_table",
    "INSERT INTO guarded_table SELECT 2",
    "WITH a AS (SELECT 2) INSERT INTO guarded_table SELECT * FROM a",
    "FROM guarded_table INSERT INTO guarded_table SELECT 1",
    "CREATE TABLE guarded_other AS SELECT 1 AS a",
    "CREATE TEMPORARY VIEW guarded_view AS SELECT 1",
    "TRUNCATE TABLE guarded_table",
    "MERGE INTO guarded_table USING guarded ON a = id WHEN MATCHED THEN DELETE",
    "SET spark.sql.ansi.enabled = false",
    "ADD JAR '/nowhere.jar'",
    "CACHE TABLE guarded",
    "REFRESH TABLE guarded",
    "ANALYZE TABLE guarded_table COMPUTE STATISTICS",
    "USE default",
    "CALL something()",
    "EXECUTE IMMEDIATE 'DROP TABLE guarded_table'",
    "BEGIN DROP TABLE guarded_table; END",
    "SELECT * FROM IDENTIFIER('guarded')",
    "SELECT TRANSFORM (id) USING 'cat' AS (x) FROM guarded",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT * FROM guarded WHERE id IN (SELECT max(reflect('java.lang.System', 'lineSeparator')) FROM guarded)",
    "WITH a AS (SELECT builtin.try_reflect('java.lang.System', 'lineSeparator') AS x) SELECT * FROM a",
    "SELECT * FROM guarded_hiding",
    "SELECT * FROM parquet.`/nowhere`",
    "SELECT * FROM guarded WHERE EXISTS (SELECT * FROM CSV.`/nowhere`)",
    "SELECT nope FROM guarded",
    "SELECT * FROM guarded_nowhere",
    "SELEC 1",
    "",
    "  -- nothing",
]


@pytest.fixture(scope="module")
def there(spark):
    spark.range(5).createOrReplaceTempView("guarded")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW guarded_hiding AS SELECT java_method('java.lang.System', 'lineSeparator') AS x")
    spark.sql("CREATE TABLE IF NOT EXISTS guarded_table USING parquet AS SELECT 1 AS a")
    yield spark
    spark.sql("DROP TABLE guarded_table")


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(there, sql):
    assert sqlguard.validate(there, sql) is None
    assert text2sql.execute(there, sql).error is None


@pytest.mark.parametrize("sql", REFUSED)
def test_refused_and_not_run(there, sql):
    ansi = there.conf.get("spark.sql.ansi.enabled")
    assert sqlguard.validate(there, sql)
    assert text2sql.execute(there, sql).error
    assert there.table("guarded_table").collect() == [(1,)] and not there.catalog.tableExists("guarded_other") and there.conf.get("spark.sql.ansi.enabled") == ansi


def test_refusal_needs_no_names(there):
    assert sqlguard.refusal(there, "SELECT * FROM guarded_nowhere") is None and sqlguard.refusal(there, "DROP TABLE guarded_nowhere")


def test_statements_of_a_table(there):
    rows = [(1, "SELECT id FROM guarded"), (2, "DROP VIEW guarded"), (3, None), (4, "SELECT id FROM guarded")]
    got = {r.i: r.error for r in text2sql.validated(there.createDataFrame(rows, "i int, sql string")).collect()}
    assert got[1] is None and got[4] is None and "DropView" in got[2] and got[3] is None
