"""N-gram Jaccard self-join by chosen paths, and the groups that its links form.

A document is the set of its five-word shingles (``textops.words``; a text of one to four words is
one shingle of all of them).  Documents with equal sets form a class, represented by their smallest
doc_id, and only representatives are joined.

1. Choosing: a shingle of a set of size L is sampled where its hash falls below ``SAMPLE / L``, and
   chosen as a first path step where it falls below ``RUNS / (threshold * L)``: ``RUNS`` disjoint
   slices of the hash range, each a run of the chosen-path recursion.
2. Splitting: a bucket of at most ``SMALL`` members is a leaf.  Of a larger one, members that have
   ``ENOUGH`` leaf steps leave (a similar partner shares one of those), others take their ``PATHS`` smallest wide steps and
   split on ``SPLITS`` shingles drawn anew under the path, up to ``DEPTH`` times.
3. Brute force: members of a leaf are compared by their samples with a margin below the threshold;
   buckets that do not split are compared in pairs of blocks.  What remains are spanning edges of
   candidate groups, never all pairs.
4. Checking: the sets of each candidate group are compared exactly, all pairs of the group, again in
   pairs of blocks if it is large.  A task gets two blocks at most and returns a count per document
   and spanning edges, so neither a group of copies nor a common passage grows a task or the output.

Recall: a pair at the threshold t = 0.8 is not linked with a probability of at most ``missed()`` = 4.9e-4, the sum of: no shared
first step in any run, exp(-RUNS); no shared one among ``ENOUGH`` leaf steps, (1-t)^ENOUGH; none among the ``PATHS``
smallest wide steps, (1-t)^PATHS; all shared wide paths failing in a split; the samples' similarity below the margin.  Since only
one path through a group's links has to be found before all its pairs are compared, pairs in larger groups are missed less often.

Cost: exact link counts of a group of m different sets that are all alike take m^2/2 comparisons, in m / ``BLOCK`` blocks; a set is
sent once for each block of its group.  Equal sets are one member, so copies cost nothing; 100,000 near copies of one text that
all differ are 5e9 comparisons of about a microsecond, which is where exact counts stop being cheap.

Defined cases: null, empty and wordless texts have no shingles, hence no links, and are classes of
their own.  A null doc_id comes back with class_id null and no links.  Rows with the same doc_id are
the same document; the class's smallest doc_id wins every tie.  A very long text is one set of all its shingles; blocks hold
``BLOCK`` sets or about ``BLOCK_BYTES`` of them, whichever is less.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspine.llm import textops
from larkspine.llm.components import components
from larkspine.llm.shared import written

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9995
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 / math.e))
SAMPLE = 48
MARGIN = 0.25
SMALL = 256
ENOUGH = 7
PATHS = 6
SPLITS = 3
DEPTH = 3
#: Members of a block, of whole sets and of samples (400 bytes each, so that more fit).
BLOCK = 1024
SAMPLES_BLOCK = 2048
#: Of the sets in a block, on average over the blocks of a group.
BLOCK_BYTES = 32 << 20
_TOP = float(1 << 64)
_SETS = "doc_id long, k1 long, k2 long, size long, sample binary, chosen array<long>"


def missed(t: float = THRESHOLD) -> float:
    """An upper bound on the probability that a pair of similarity ``t`` is not linked."""
    first = math.exp(-RUNS)
    off = 1 - t
    # Of k shared wide paths each fails in one of the splits with this probability; k is Poisson, or binomial where PATHS cuts it.
    split = 1 - (1 - off**SPLITS) ** (DEPTH - 1)
    poisson = sum(math.exp(-RUNS) * RUNS**k / math.factorial(k) * split**k for k in range(1, 4 * RUNS))
    cut = sum(math.comb(PATHS, k) * t**k * off ** (PATHS - k) * split**k for k in range(1, PATHS + 1))
    # About SAMPLE / t shingles of the union are sampled.
    n = round(SAMPLE / t)
    below = sum(math.comb(n, k) * t**k * off ** (n - k) for k in range(math.ceil((t - MARGIN) * n)))
    return first + off**ENOUGH + off**PATHS + poisson + cut + below


def _limit(share: np.ndarray) -> np.ndarray:
    """The hash value below which this share of hashes lies."""
    return np.where(share >= 1, (1 << 64) - 1, (np.minimum(share, 1 - 1e-12) * _TOP)).astype(np.float64).clip(0, _TOP * (1 - 2.0**-53)).astype(np.uint64)


def shingle_sets(texts: pa.Array, width: int = WIDTH):
    """Per step: (rows, sorted distinct shingle hashes, their row)."""
    for lo, hi, buf, off in textops.steps(texts):
        w = textops.words(buf, off)
        h, row, _ = textops.windows(w.hash, w.first, width)
        h, row, _ = textops.distinct_by_row(textops.mix(h, 21), row)
        yield hi - lo, h, row


def _sets(threshold: float):
    def run(batches):
        for batch in batches:
            at = 0
            for rows, h, row in shingle_sets(batch.column(1)):
                size = np.bincount(row, minlength=rows)
                edge = np.concatenate([[0], np.cumsum(size)])
                k1 = np.zeros(rows, np.uint64)
                k2 = np.zeros(rows, np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    k1[full] = np.add.reduceat(textops.mix(h, 31), edge[full])
                    k2[full] = np.add.reduceat(textops.mix(h, 32), edge[full])
                share = 1 / np.maximum(size, 1)
                kept, first = (h < _limit(SAMPLE * share)[row]), (h < _limit(RUNS / threshold * share)[row])
                hk, ck = h[kept], h[first]
                ek = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=rows))])
                ec = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=rows))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, rows),
                        pa.array(k1.view(np.int64), mask=size == 0),
                        pa.array(k2.view(np.int64), mask=size == 0),
                        pa.array(size),
                        pa.array([hk[ek[i] : ek[i + 1]].tobytes() for i in range(rows)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ec, pa.int32()), pa.array(ck.view(np.int64))),
                    ],
                    ["doc_id", "k1", "k2", "size", "sample", "chosen"],
                )
                at += rows

    return run


def _forest(linked: np.ndarray, left: slice, right: slice, n: int) -> np.ndarray:
    """Smallest position of each position's component, from a matrix of links between two ranges of positions; rows are looked at in steps, so a
    dense matrix is never a list of pairs."""
    low = np.arange(n)
    step = max(1, (1 << 20) // max(1, linked.shape[1]))
    while linked.any():
        before, l, r = low.copy(), low[left], low[right]
        for at in range(0, len(linked), step):
            some = linked[at : at + step]
            l[at : at + step] = np.minimum(l[at : at + step], np.where(some, r, n).min(axis=1))
            r = np.minimum(r, np.where(some, l[at : at + step, None], n).min(axis=0))
        low = before.copy()
        low[left] = np.minimum(low[left], l)
        low[right] = np.minimum(low[right], r)
        low = low[low]
        if (low == before).all():
            break
    return low


def _shared(tokens: list[np.ndarray], left: slice, right: slice) -> np.ndarray:
    """Numbers of shared tokens, left rows x right rows."""
    sizes = [len(t) for t in tokens]
    n = len(tokens)
    code = np.concatenate(tokens) if n else np.zeros(0, np.uint64)
    _, code, count = np.unique(code, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    keep = count[code] > 1
    code, row = code[keep], row[keep]
    nl, nr = left.stop - left.start, right.stop - right.start
    out = np.zeros((nl, nr), np.float32)
    if not len(code):
        return out
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    total = int(code[-1]) + 1
    step = max(64, (8 << 20) // max(n, 1))
    for lo in range(0, total, step):
        s = slice(*np.searchsorted(code, (lo, lo + step)))
        m = np.zeros((n, min(step, total - lo)), np.float32)
        m[row[s], code[s] - lo] = 1
        out += m[left] @ m[right].T
    return out


def _by_group(batches, width: int):
    """Rows of consecutive batches that are equal in column 0, as lists of columns 1..width."""
    key, held = None, [[] for _ in range(width)]
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(width + 1)]
        for i, k in enumerate(cols[0]):
            if k != key:
                if held[0]:
                    yield key, held
                key, held = k, [[] for _ in range(width)]
            for c in range(width):
                held[c].append(cols[c + 1][i])
    if held[0]:
        yield key, held


def _candidates(cutoff: float):
    """Spanning edges of the members whose samples agree; columns: bucket, side, rep, size, sample."""

    def run(batches):
        for _, (side, rep, size, sample) in _by_group(batches, 4):
            pairs = {}
            for s, r, n, t in zip(side, rep, size, sample):
                pairs.setdefault((s, r), (n, t))
            keys = sorted(pairs)
            nl = sum(k[0] <= 0 for k in keys)
            ids = [k[1] for k in keys]
            split = keys[0][0] == 0 and keys[-1][0] == 1
            if len(ids) < 2 or (keys[-1][0] == 1 and not split):
                continue
            sizes = np.array([pairs[k][0] for k in keys], float)
            tokens = [np.frombuffer(pairs[k][1], np.uint64) for k in keys]
            left, right = (slice(0, nl), slice(nl, len(ids))) if split else (slice(0, len(ids)),) * 2
            shared = _shared(tokens, left, right)
            limits = _limit(SAMPLE / sizes)
            li, ri = np.arange(left.start, left.stop), np.arange(right.start, right.stop)
            a = np.stack([np.searchsorted(tokens[i], np.minimum(limits[ri], limits[i])).astype(np.int32) for i in li])
            a += np.stack([np.searchsorted(tokens[j], np.minimum(limits[li], limits[j])).astype(np.int32) for j in ri]).T
            linked = shared >= cutoff * np.maximum(a - shared, 1)
            if not split:
                np.fill_diagonal(linked, False)
            low = _forest(linked, left, right, len(ids))
            far = np.flatnonzero(low != np.arange(len(ids)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in far], pa.int64()), pa.array([ids[low[x]] for x in far], pa.int64())], ["a", "b"])

    return run


def _checked(threshold: float):
    """Exact links within a pair of blocks; columns: pair of blocks, side, rep, weight, set. Edges carry to, counts carry n."""

    def run(batches):
        for _, (side, rep, weight, sets) in _by_group(batches, 4):
            rows = {}
            for s, r, w, t in zip(side, rep, weight, sets):
                rows.setdefault((s, r), (w, t))
            keys = sorted(rows)
            ids = [k[1] for k in keys]
            nl = sum(k[0] <= 0 for k in keys)
            split = keys[0][0] == 0 and keys[-1][0] == 1
            if len(ids) < 2 or (keys[-1][0] == 1 and not split):
                continue
            tokens = [np.frombuffer(rows[k][1], np.uint64) for k in keys]
            weights = np.array([rows[k][0] for k in keys], np.int64)
            left, right = (slice(0, nl), slice(nl, len(ids))) if split else (slice(0, len(ids)),) * 2
            shared = _shared(tokens, left, right)
            sizes = np.array([len(t) for t in tokens], float)
            linked = shared >= threshold * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-6
            if not split:
                np.fill_diagonal(linked, False)
            n = np.zeros(len(ids), np.int64)
            n[left] += linked @ weights[right]
            if split:
                n[right] += linked.T @ weights[left]
            low = _forest(linked, left, right, len(ids))
            has = np.flatnonzero(n)
            if len(has):
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in has], pa.int64()), pa.array([ids[low[x]] for x in has], pa.int64()), pa.array(n[has])], ["rep", "to", "n"])

    return run


def _split(batches):
    """Further steps of each member's path: the shingles whose hash under the path is smallest, in each of ``SPLITS`` runs."""
    for batch in batches:
        path, rep, sample = (batch.column(i) for i in range(3))
        out = []
        for p, t in zip(path.to_pylist(), sample.to_pylist()):
            tokens = np.frombuffer(t, np.uint64)
            own = np.uint64(p & ((1 << 64) - 1))
            tokens = tokens[tokens != own]
            steps = []
            for k in range(1, SPLITS + 1):
                if len(tokens):
                    got = textops.mix(tokens ^ own, 40 + k)
                    steps.append(int(got.min().view(np.int64)))
            out.append(steps)
        yield pa.RecordBatch.from_arrays([path, rep, pa.array(out, pa.list_(pa.int64()))], ["parent", "rep", "steps"])


def _blocked(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows of a bucket as pairs of so many blocks: bucket (string), side (0, 1; -1 where the pair is one block with itself)."""
    k = F.ceil(blocks).cast("int")
    mine = F.pmod(F.xxhash64("rep"), k).cast("int")
    other = F.explode(F.sequence(F.lit(0), k - 1))
    rows = rows.withColumn("_k", k).withColumn("_b", mine).withColumn("_o", other)
    low, high = F.least("_b", "_o"), F.greatest("_b", "_o")
    side = F.when(F.col("_b") == F.col("_o"), -1).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return rows.withColumn("bucket", F.concat_ws(":", F.col(key).cast("string"), low.cast("string"), high.cast("string"))).withColumn("side", side).drop("_k", "_b", "_o")


def candidate_edges(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Spanning edges (a, b) of candidate groups among representatives (rep, size, sample, chosen)."""
    spark = reps.sparkSession
    info = reps.select("rep", "size", "sample")
    rows = reps.select(F.explode("chosen").alias("path"), "rep")
    leaves = None
    for depth in range(1, DEPTH + 1):
        sized = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("rep")).alias("same"))
        stepped = written(spark, rows.join(sized.where(F.col("m") <= SMALL), "path"), "stepped")
        # Buckets with the same members are one; the key is a hash of the members.
        leaf = stepped.where("m > 1").select(F.concat(F.lit("s"), F.col("same").cast("string")).alias("bucket"), F.lit(-1).alias("side"), "rep").distinct()
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        wide = sized.where(F.col("m") > SMALL).select("path")
        if depth == 1:
            enough = stepped.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ENOUGH).select("rep")
            busy = reps.join(enough, "rep", "left_anti").select(F.explode("chosen").alias("path"), "rep")
            place = F.struct(F.shiftrightunsigned("path", 1).alias("u"), F.col("path"))
            own = busy.join(wide, "path").groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(place)), 1, PATHS).alias("p"))
            large = own.select(F.explode("p.path").alias("path"), "rep")
        else:
            large = rows.join(wide, "path").select("path", "rep")
        large = written(spark, large, "large")
        if large.isEmpty():
            break
        parents = large.groupBy("path").agg(F.count(F.lit(1)).alias("m"))
        if depth == DEPTH:
            leaves = leaves.unionByName(_blocked(large.join(parents.where("m > 1"), "path"), "path", F.col("m") / SAMPLES_BLOCK).select("bucket", "side", "rep"))
            break
        split = large.join(info.select("rep", "sample"), "rep").select("path", "rep", "sample").mapInArrow(_split, "parent long, rep long, steps array<long>")
        child = written(spark, split.select("parent", "rep", F.explode("steps").alias("path")), "child")
        grown = child.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("m")).join(parents.select(F.col("path").alias("parent"), F.col("m").alias("was")), "parent")
        dense = grown.where((F.col("m") > SMALL) & (F.col("m") >= 0.5 * F.col("was"))).select("path", "m")
        leaves = leaves.unionByName(_blocked(child.select("path", "rep").join(dense, "path"), "path", F.col("m") / SAMPLES_BLOCK).select("bucket", "side", "rep"))
        rows = child.select("path", "rep").join(dense.select("path"), "path", "left_anti")
    table = leaves.join(info, "rep").select("bucket", "side", "rep", "size", "sample")
    table = table.repartition("bucket").sortWithinPartitions("bucket")
    return table.mapInArrow(_candidates(threshold - MARGIN), "a long, b long")


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, rep_id, n_links for every document.

    ``rep_id``: smallest doc_id with the same shingles; ``class_id``: smallest doc_id of the group
    that links of at least ``threshold`` connect; ``n_links``: number of other documents that are as similar.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = written(spark, texts.mapInArrow(_sets(threshold), _SETS), "sets")
    classes = sets.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("weight"))
    named = written(spark, sets.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "rep", F.coalesce("weight", F.lit(1)).alias("weight")), "named")
    first = named.where("doc_id = rep").select("k1", "k2", "rep", "weight").distinct()
    reps = written(spark, sets.where("k1 is not null").withColumnRenamed("doc_id", "rep").join(first, ["rep", "k1", "k2"]).dropDuplicates(["rep"]).select("rep", "weight", "size", "sample", "chosen"), "reps")
    groups = components(candidate_edges(reps, threshold))
    groups = written(spark, groups.join(reps.select("rep", "weight", "size"), F.col("node") == F.col("rep")).select("root", "rep", "weight", "size"), "groups")
    per_root = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.col("m") / BLOCK, F.col("shingles") * 8 / BLOCK_BYTES).alias("blocks")
    sized = groups.join(per_root.select("root", blocks), "root")
    # Groups' members are a share of all documents, so neither side has a size that would allow a broadcast.
    found = sized.hint("merge").join(texts, F.col("rep") == F.col("doc_id")).select("root", "blocks", "rep", "weight", "text")

    def full(batches):
        for batch in batches:
            at = 0
            for rows, h, row in shingle_sets(batch.column(4)):
                edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
                got = pa.array([h[edge[i] : edge[i + 1]].tobytes() for i in range(rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, rows) for c in range(4)), got], ["root", "blocks", "rep", "weight", "shingles"])
                at += rows

    whole = found.mapInArrow(full, "root long, blocks double, rep long, weight long, shingles binary")
    blocks = _blocked(whole, "root", F.col("blocks")).select("bucket", "side", "rep", "weight", "shingles")
    links = written(spark, blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_checked(threshold), "rep long, to long, n long"), "links")
    roots = components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    per_rep = counts.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("of"), "n", F.coalesce("root", "rep").alias("root"))
    joined = named.join(per_rep, F.col("rep") == F.col("of"), "left")
    rep = F.coalesce("rep", "doc_id")
    return joined.select("doc_id", F.coalesce("root", rep).alias("class_id"), rep.alias("rep_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their group, with all columns; a null doc_id stays."""
    spark = docs.sparkSession
    gone = written(spark, ngram_join(docs, threshold).where("doc_id <> class_id").select("doc_id").distinct(), "gone").alias("gone")
    return docs.alias("rows").join(gone, F.col("rows.doc_id") == F.col("gone.doc_id"), "left_anti")
