"""Connected components over a table of edges, by alternating large-star and small-star steps.

Each step keeps at most as many edges as it got, and a step's result is written to the shared
folder, so lineage stays short and a lost executor costs one step.  The node of a large star is a hot key of the join that
Spark's skew join splits; an edge is two numbers, and a step combines per task before it shuffles minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspine.llm.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node go to its smallest neighbour (or itself); small star: those below and itself do."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
    near = both.join(low, both["a"] == low["node"])
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select(F.col("node").alias("a"), F.col("low").alias("b")))
    out = out.where("a <> b")
    return out if large else out.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node that isn't a root has one edge, to a root."""
    chained = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return chained.isEmpty() and edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame, most_steps: int = 40) -> DataFrame:
    """node, root (the component's smallest node) for every node of ``edges`` (a, b: long)."""
    spark = edges.sparkSession
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_steps):
        if _settled(now):
            break
        now = written(spark, _star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
