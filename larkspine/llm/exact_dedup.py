"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after deleting ASCII whitespace.  Three stages, each
grouping by the SHA-256 of the normalised text and the normalised text itself, so that full
content is compared every time: rows of one task are combined where they are read (the partial
aggregate), the survivors meet in salted groups, and the winners of the salts meet globally.  A
task that holds any number of copies sends one row for them, and a group's winners are at most
``SALTS``, so no group of copies can overload a task.

Of equal texts, the row with the most code points in the original text stays, then the smallest
doc_id.  Null texts count as empty; empty texts equal each other.  A null doc_id loses ties.
Rows repeated with the same doc_id and text count as rows of the group; each names the same
keeper.  A text of any length is one value of a row, compared whole.  Extra columns are ignored; ``keep_distinct`` passes
them through, and of repeated rows keeps one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII whitespace.
SPACES = " \t\n\x0b\x0c\r"
SALTS = 16

_SHIFT = 1 << 65


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def _rank(length: Column, doc_id: Column) -> Column:
    """Smaller is better; a decimal, so that the aggregate stays in a hash map: longest, then smallest doc_id."""
    big = F.lit(str(_SHIFT)).cast("decimal(20,0)")
    top = (F.lit((1 << 31) - 1) - length).cast("decimal(11,0)") * big
    return (top.cast("decimal(38,0)") + F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")) + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(38,0)")


def _kept_id(rank: Column) -> Column:
    big = F.lit(str(_SHIFT)).cast("decimal(38,0)")
    raw = (rank % big) - F.lit(str(1 << 63)).cast("decimal(38,0)")
    return F.when(raw < F.lit(str(1 << 63)).cast("decimal(38,0)"), raw.cast("long"))


def winners(docs: DataFrame) -> DataFrame:
    """text_sha256, keep_id, group_size: one row per distinct normalised text."""
    norm = normalised(F.col("text"))
    rows = docs.select(
        F.sha2(norm, 256).alias("text_sha256"),
        norm.alias("norm"),
        F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"),
        _rank(F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.col("doc_id")).alias("rank"),
    )
    salted = rows.groupBy("text_sha256", "norm", "salt").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("text_sha256", "norm").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))
    return merged.select("text_sha256", _kept_id(F.col("rank")).alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    The join back to the rows is on the digest; the few digests of hot groups are split by
    Spark's skew join.
    """
    sha = F.sha2(normalised(F.col("text")), 256).alias("text_sha256")
    return (
        docs.select("doc_id", sha)
        .join(winners(docs), "text_sha256")
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")
    )


def keep_distinct(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each distinct normalised text, with all columns."""
    extra = "text_sha256"
    while extra in docs.columns:
        extra += "_"
    kept = winners(docs).alias("kept")
    tagged = docs.withColumn(extra, F.sha2(normalised(F.col("text")), 256)).alias("rows")
    same = tagged.join(kept, (F.col(f"rows.{extra}") == F.col("kept.text_sha256")) & F.col("rows.doc_id").eqNullSafe(F.col("kept.keep_id")), "left_semi")
    return same.dropDuplicates(["doc_id", extra]).drop(extra)
