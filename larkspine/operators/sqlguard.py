"""Which SQL statements may run: Spark's own parser and analyser say what a statement is, and nothing runs to find out.

A statement is allowed if its plan consists of nodes of queries, whatever it is written like (``WITH``, literals with semicolons, comments).
What is not known to be harmless is refused: commands that change something, statements that build statements, scripts,
functions that call into the JVM, and files that are named by path instead of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import SparkSession

#: Spark's names of the nodes of queries, of commands that only tell, of functions that leave SQL, and of file formats.
QUERY_NODES = frozenset(
    "Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join "
    "LateralJoin LocalLimit LocalRelation Offset OneRowRelation OrderedSubquery PipeOperator Pivot Project Range Repartition "
    "RepartitionByExpression Sample Sort Subquery SubqueryAlias Tail Transpose Union UnresolvedHaving UnresolvedHint "
    "UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases "
    "UnresolvedWith Unpivot Values Window WithCTE WithWindowDefinition".split()
)
TELLING_COMMANDS = frozenset(
    "DescribeColumn DescribeColumnCommand DescribeFunction DescribeFunctionCommand DescribeNamespace DescribeQueryCommand DescribeRelation "
    "DescribeTableCommand ExplainCommand ShowColumns ShowColumnsCommand ShowCreateTable ShowFunctions ShowFunctionsCommand ShowNamespaces ShowNamespacesCommand ShowPartitions "
    "ShowTableExtended ShowTableProperties ShowTables ShowTablesCommand ShowViews ShowViewsCommand".split()
)
NAMES_OF_COMMANDS = frozenset("UnresolvedTable UnresolvedTableOrView UnresolvedView UnresolvedNamespace UnresolvedFunctionName UnresolvedIdentifier CurrentNamespace UnresolvedAttribute ResolvedNamespace".split())
LEAVING_FUNCTIONS = frozenset(("java_method", "reflect", "try_reflect"))
LEAVING_EXPRESSIONS = frozenset(("CallMethodViaReflection", "TryReflect"))
FILE_FORMATS = frozenset(("parquet", "orc", "json", "csv", "text", "binaryfile", "avro", "xml", "delta", "jdbc"))


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _plans(plan) -> Iterator:
    """A plan and all plans below it and in its expressions."""
    yield plan
    for more in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for p in _each(more):
            yield from _plans(p)


def _expressions(plan) -> Iterator:
    todo = list(_each(plan.expressions()))
    while todo:
        e = todo.pop()
        yield e
        todo += _each(e.children())


def _parsed(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _refused(plan) -> str | None:
    if _kind(plan) == "ExplainCommand":  # plans and shows its statement, which runs nothing but must be a query itself
        return _refused(plan.logicalPlan())
    telling = _kind(plan) in TELLING_COMMANDS
    for p in _plans(plan):
        kind = _kind(p)
        if kind not in QUERY_NODES and not (telling and (p.equals(plan) or kind in NAMES_OF_COMMANDS)):
            return f"{kind} is not allowed, only queries are"
        if kind == "UnresolvedRelation":
            parts = [x.lower() for x in _each(p.multipartIdentifier())]
            if len(parts) == 2 and parts[0] in FILE_FORMATS:
                return f"files named by path are not allowed: {'.'.join(parts)}"
        if kind == "UnresolvedTableValuedFunction":
            name = list(_each(p.name()))[-1].lower()
            if name in LEAVING_FUNCTIONS:
                return f"the function {name} is not allowed"
        for e in _expressions(p):
            if _kind(e) == "UnresolvedFunction" and (name := list(_each(e.nameParts()))[-1].lower()) in LEAVING_FUNCTIONS:
                return f"the function {name} is not allowed"
    return None


def _analysed(spark: SparkSession, plan):
    """The plan with names resolved; commands stay as they are, because nothing executes a plan here."""
    tracker = spark._jvm.org.apache.spark.sql.catalyst.QueryPlanningTracker(spark._jvm.scala.Option.empty())
    return spark._jsparkSession.sessionState().analyzer().executeAndCheck(plan, tracker)


def refusal(spark: SparkSession, sql: str) -> str | None:
    """Why a statement may not run, without regard to the names in it; None if it may."""
    try:
        return _refused(_parsed(spark, sql))
    except (ParseException, AnalysisException) as e:
        return str(e)


def validate(spark: SparkSession, sql: str) -> str | None:
    """Why a statement may not or cannot run: refused, wrong, or of names that are not there; None if it can.  Runs nothing."""
    try:
        plan = _parsed(spark, sql)
        if why := _refused(plan):
            return why
        if _kind(plan) == "ExplainCommand":
            plan = plan.logicalPlan()
        found = _analysed(spark, plan)
        # What views and SQL functions hide shows once names are resolved.
        for p in _plans(found):
            for e in _expressions(p):
                if _kind(e) in LEAVING_EXPRESSIONS:
                    return f"{e.prettyName()} is not allowed"
    except PySparkException as e:
        return str(e)
    return None
