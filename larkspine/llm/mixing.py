"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words.  Targets: sources in code-point order (null last) weigh
5, 2, 1, repeating, and share ``total_share`` of all words; a target stops at ``most`` times its
source's words and the excess is shared again by weight until none is above.

Rates of documents lie between 0 and ``most`` and are as near as possible, in the binary entropy
scaled to that range, to the overall rate, given that each source's expected words equal its
target.  The solution is an exponential tilt, ``most * logistic(base + lambda * size / mean size)``
with one multiplier per source; Newton steps on the convex dual, kept within a bracket, run over
the table of (source, size, documents), so an iteration reads distinct sizes, not documents.  The
sums are exact decimals, so every run gives the same multipliers.

Rates are then rounded into whole copies: within a block of one source, documents from long to
short carry the remaining words on to the next.  A block holds about ``BLOCK`` documents, chosen by
a hash of doc_id, so a hot source is many blocks.

Targets are found in one task, which sorts the sources (their names and sizes, not their documents).

Defined cases: null or empty texts have size 0 and take 0 words; a source without words has target
0; no documents give no rows; rows repeated with the same doc_id are documents of their own.  Documents of equal size
go in order of doc_id, null first, and repeated rows in either order, since they are alike.  A very long text is one document: a
source that consists of few of them comes only as near its target as a whole copy allows.  If Newton's steps
do not settle, an error is raised.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspine.llm.shared import written

#: Weights of the sources in order.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST = 2.0
BLOCK = 4_000
STEPS = 60
TOLERANCE = 1e-7
#: Parts of a word that sums are counted in.
_UNITS = 1_000_000_000


def size_column(text: str = "text") -> Column:
    """Number of runs of characters that are not ASCII whitespace."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): waterfilling in one window over the sources.

    In the order of source_size / weight, the sources that stop at the limit are a prefix: the
    limit binds where most * size / weight is below the level that the others then share.  That
    level falls with each further source taken as bound, so the first that isn't bound has the largest.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    n = F.row_number().over(order) - 1
    weight = F.lit(None)
    for k, v in enumerate(weights):
        weight = F.when(n % len(weights) == k, F.lit(float(v))).otherwise(weight)
    rows = sizes.withColumn("weight", weight)
    everything = Window.partitionBy()
    ranked = rows.withColumn("ratio", F.col("source_size") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    bound = F.col("level") * F.col("weight") >= most * F.col("source_size")
    final = F.max(F.when(~bound, F.col("level"))).over(Window.partitionBy())
    return leveled.withColumn("final", final).select(
        "source",
        "source_size",
        F.when(bound | F.col("final").isNull(), most * F.col("source_size")).otherwise(F.col("final") * F.col("weight")).cast("double").alias("target"),
    )


def _base(most: float) -> float:
    """The tilt at which every rate is the overall one."""
    return math.log(TOTAL_SHARE / (most - TOTAL_SHARE))


def _rate(lam: Column, base: float, most: float) -> Column:
    return most / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(base) + lam * F.col("size") / F.col("mean")))))


def balance(histogram: DataFrame, wanted: DataFrame, most: float = MOST, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """source, mean, lam: multipliers for which the expected words of each source equal its target.

    ``histogram``: source, size, n.  All sources take their Newton steps together; each step is
    one aggregation over the histogram.  Sources at the limit, or with no target, need no multiplier.
    """
    spark = histogram.sparkSession
    base = _base(most)
    stats = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    state = stats.join(wanted, stats["source"].eqNullSafe(wanted["source"])).select(
        stats["source"],
        (F.greatest(F.col("words"), F.lit(1)) / F.col("docs")).alias("mean"),
        F.col("target"),
        F.lit(0.0).alias("lam"),
        F.lit(-1e4).alias("lo"),
        F.lit(1e4).alias("hi"),
        F.col("words"),
    ).where((F.col("target") > 0) & (F.col("target") < most * F.col("words"))).drop("words")
    state = written(spark, state, "mix-state")
    exact = lambda c: F.sum((c * _UNITS).cast("decimal(38,0)")).cast("double") / _UNITS
    for _ in range(steps):
        s = state.select(F.col("source").alias("of"), "mean", "target", "lam", "lo", "hi")
        rate = _rate(F.col("lam"), base, most)
        words = F.col("n") * F.col("size")
        got = (
            histogram.join(s, F.col("source").eqNullSafe(F.col("of")))
            .groupBy("source", "mean", "target", "lam", "lo", "hi")
            .agg(exact(words * rate).alias("have"), exact(words * F.col("size") / F.col("mean") * rate * (1 - rate / most)).alias("slope"))
        )
        gap = F.col("have") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.greatest(F.col("slope"), F.lit(1e-9))
        moved = got.withColumns({"gap": gap, "lo": lo, "hi": hi, "next": newton})
        inside = (F.col("next") > F.col("lo")) & (F.col("next") < F.col("hi"))
        near = F.abs("gap") <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        half = F.when(F.col("lo") <= -1e4, F.least(F.col("lam") * 2, F.lit(0.0)) - 1).when(F.col("hi") >= 1e4, F.greatest(F.col("lam") * 2, F.lit(0.0)) + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = written(
            spark,
            moved.select("source", "mean", "target", F.when(near, F.col("lam")).when(inside, F.col("next")).otherwise(half).alias("lam"), "lo", "hi", near.alias("near")),
            "mix-state",
        )
        if state.where(~F.col("near")).isEmpty():
            break
        state = state.drop("near")
    else:
        raise RuntimeError(f"multipliers did not settle in {steps} steps")
    return state.select("source", "mean", "lam")


def _carried(batches):
    """Copies of documents that come sorted by block and from long to short; the carry starts anew with each block."""
    block, carry = None, 0.0
    for batch in batches:
        keys, sizes, wants = (batch.column(k).to_pylist() for k in (1, 2, 3))
        out = []
        for key, size, want in zip(keys, sizes, wants):
            if key != block:
                block, carry = key, 0.0
            copies = 0
            if size:
                carry += want * size
                copies = int(min(2, max(0, round(carry / size))))
                carry -= copies * size
            out.append(copies * size)
        yield pa.RecordBatch.from_arrays([*batch.columns[4:], batch.column(0), batch.column(2), pa.array(out, pa.int64())], [*batch.schema.names[4:], "doc_id", "size", "taken"])


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document; taken / size is the number of copies."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", size_column().alias("size"))
    sized = written(spark, sized, "mix-sizes")
    histogram = written(spark, sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs"))
    wanted = written(spark, targets(per_source.select("source", "source_size")), "mix-targets")
    lam = balance(histogram.where("size > 0"), wanted)
    base = _base(MOST)
    w, p, m = wanted.alias("w"), per_source.alias("p"), lam.alias("m")
    plan = (
        w.join(p, F.col("w.source").eqNullSafe(F.col("p.source")))
        .join(m, F.col("w.source").eqNullSafe(F.col("m.source")), "left")
        .select(F.col("w.source").alias("of"), F.col("w.source_size").alias("source_size"), F.col("w.target").alias("target"), F.col("p.source_docs").alias("source_docs"), F.coalesce("m.mean", F.lit(1.0)).alias("mean"), F.coalesce("m.lam", F.lit(0.0)).alias("lam"))
    )
    rate = F.when(F.col("target") >= MOST * F.col("source_size"), F.lit(MOST)).otherwise(F.round(_rate(F.col("lam"), base, MOST), 12))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / block)).cast("long")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id",
        F.concat_ws(":", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), F.pmod(F.xxhash64("doc_id"), blocks).cast("string")).alias("block"),
        "size",
        rate.alias("rate"),
        "source",
        "source_size",
        "target",
    )
    dealt = rows.repartition(F.col("block")).sortWithinPartitions("block", F.desc("size"), "doc_id")
    return dealt.mapInArrow(_carried, "source string, source_size long, target double, doc_id long, size long, taken long").select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, copies, target of the documents that the mix takes at least once."""
    return mix(docs).where("taken > 0").select("doc_id", "source", "size", (F.col("taken") / F.col("size")).cast("int").alias("copies"), "taken", "target")
