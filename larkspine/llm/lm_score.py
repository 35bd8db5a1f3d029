"""Language-model scoring by cross-entropy difference.

N-gram models of the same order and smoothing share one vocabulary, the bytes of the text after
case folding with every run of non-word bytes as one space.  The background model counts every
document.  The target documents, which a table of ids names, are dealt into two halves by a hash of their texts, and each
half gives a model; a document, target or not, is scored by the half that its text does not belong to.  So no target document, nor
an exact copy of one, is scored by counts of itself, and all are scored by models of about the same size.  A document's score is the mean
over its tokens of the target loss minus the background loss, so low scores are like the target.

All counts are exact.  Every token ends one n-gram of ``ORDER`` bytes, which is its own 40-bit key, and the counts of
all shorter n-grams and of all contexts are sums of its counts.  Documents lie in blocks of about ``BLOCK_BYTES``
(a number that follows the counted bytes).  A block's task adds up its n-grams, so an n-gram is one entry a block however
frequent, and sends them to parts by their middle bytes: a part then holds all counts that the two longest orders need.
Orders up to three are a table over the alphabet (``SIZE`` letters, ``SIZE ** 3`` entries at most, exact), which is all that is
collected and broadcast.  A part's counts are added up as they stream by, first over ``SPAN`` blocks at a time, so a task holds the
distinct n-grams of a part, not what all blocks sent; its losses then go out to each span of blocks, where the
blocks' n-grams stream by again and return with them to their block, to meet the texts.  Blocks go by
a hash of the row, not by where a row was read, so that both passes agree and a lost executor's task can run again.

Probabilities are interpolated from order 1 up: ``p_n = (c(context, token) + A * p_(n-1)) / (c(context) + A)``,
with the uniform distribution over the vocabulary below order 1.

Defined cases: null, empty and wordless texts have 0 tokens and score null; without target documents
the target models are uniform; ids that no document has are ignored; repeated rows, and documents of equal texts, count as often as
they occur.  A very long text is counted and scored in its block in steps; a block is as large as its longest texts at least.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspine.llm import textops
from larkspine.llm.shared import written

ORDER = 5
VOCABULARY = 256
SMOOTHING = 8.0
#: Bytes of text of a block, on average; a block's n-grams are held in one task.
BLOCK_BYTES = 16 << 20
#: Parts of the n-grams at most.  Distinct n-grams of ``ORDER`` bytes become few as text grows, so parts need not follow it, and what blocks
#: and parts exchange is at most so many rows a block.
MOST_PARTS = 1024
#: Blocks whose counts of one part one task adds up, or answers.
SPAN = 1 << 14
#: Rows that are held before their counts are added up.
HELD = 32
_U = np.uint64
#: Where a key says which half of the target documents, 1 or 2, holds the n-gram; 0 for other documents.
_HALF = _U(8 * ORDER)
_KEY = _U((1 << 8 * ORDER) - 1)
_LETTERS = np.unique(np.where(textops.WORD_BYTE, textops.LOWER_BYTE, 0x20))
SIZE = len(_LETTERS)
_RANK = np.searchsorted(_LETTERS, np.arange(256)).astype(np.int64)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte tokens and their row; each row opens with a space, and spaces never repeat."""
    b = textops.fold(buf)
    b = np.where(textops.WORD_BYTE[b], b, 0x20).astype(np.uint8)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = np.ones(len(b), bool)
    if len(b) > 1:
        keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20) | (row[1:] != row[:-1])
    first = off[:-1][np.diff(off) > 0]
    keep[first] = b[first] != 0x20
    return b[keep], row[keep]


def grams(b: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The n-gram of ``ORDER`` bytes that ends at every token, its last byte lowest; before the row's start are spaces."""
    code = b.astype(_U)
    for k in range(1, ORDER):
        back = np.full(len(b), 0x20, _U)
        if len(b) > k:
            back[k:] = np.where(row[k:] == row[:-k], b[:-k], 0x20)
        code |= back << _U(8 * k)
    return code


def _pack(x: np.ndarray) -> bytes:
    """64-bit words by planes of bytes, which compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(x: bytes, dtype=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).reshape(-1).view(dtype)


def _pack_losses(x: np.ndarray) -> bytes:
    """Three losses an n-gram, model by model."""
    return np.ascontiguousarray(x.T.astype(np.float32)).tobytes()


def _unpack_losses(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.float32).reshape(3, -1).T


def _pack_keys(x: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _pack(np.diff(x, prepend=_U(0)))


def _unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x, _U), dtype=_U)


def _added(keys: np.ndarray, *n: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[at], *(np.add.reduceat(x[order], at) if len(at) else x for x in n)]


class _Block:
    """Counts of a block's n-grams; those of target documents carry their half."""

    def __init__(self):
        self.held, self.size, self.keys, self.n = [], 0, [], []

    def add(self, codes: np.ndarray):
        self.held.append(codes)
        self.size += len(codes)
        if self.size >= 1 << 22:
            self.settle()

    def settle(self):
        if self.size:
            x = np.sort(np.concatenate(self.held))
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            self.keys.append(x[at])
            self.n.append(np.diff(np.append(at, len(x))))
            self.held, self.size = [], 0
        if len(self.keys) > 8:
            k, n = _added(np.concatenate(self.keys), np.concatenate(self.n))
            self.keys, self.n = [k], [n]

    def rows(self, block: int, parts: int):
        """(part, block, keys, counts, counts in either half of the target documents); part -1 has the last three bytes."""
        self.settle()
        if not self.keys:
            return
        keys, n = np.concatenate(self.keys), np.concatenate(self.n)
        half = keys >> _HALF
        keys, *n = _added(keys & _KEY, n, np.where(half == 1, n, 0), np.where(half == 2, n, 0))
        short, *sums = _added(keys & _U(0xFFFFFF), *n)
        yield -1, block, _pack_keys(short), *map(_pack, sums)
        part = (textops.mix((keys >> _U(8)) & _U(0xFFFFFF)) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            at = order[edges[p] : edges[p + 1]]
            yield int(p), block, _pack_keys(keys[at]), *(_pack(x[at]) for x in n)


def _counted(batches, parts: int):
    """Rows of _Block.rows() from rows (block, target, doc_id, text, half) sorted by block, the target ids before the texts."""
    now, block, ids = None, _Block(), []

    def out(rows):
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, (pa.int32(), pa.int32(), *(pa.binary(),) * 4))], ["part", "block", "keys", "n", "t1", "t2"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        named = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (named[1:] != named[:-1]), [True]])) if len(blocks) else []
        for a, z in zip(edges[:-1], edges[1:]):
            if blocks[a] != now:
                if now is not None:
                    yield from out(block.rows(now, parts))
                now, block, ids = int(blocks[a]), _Block(), []
            some = batch.slice(a, z - a)
            if named[a]:
                ids.append(some.column(1).to_numpy())
                continue
            ids = [np.concatenate([*ids, np.zeros(0, np.int64)])]
            good = np.isin(some.column(2).fill_null(0).to_numpy(), ids[0]) & some.column(2).is_valid().to_numpy(zero_copy_only=False)
            flag = np.where(good, some.column(4).to_numpy(), 0).astype(_U) << _HALF
            for lo, hi, buf, off in textops.steps(some.column(3), 1 << 19):
                b, row = tokens(buf, off)
                if len(b):
                    block.add(grams(b, row) | flag[lo:hi][row])
    if now is not None:
        yield from out(block.rows(now, parts))


def _short(batches):
    """Sums of the parts -1, as (last three letters, n, t1, t2)."""
    total = np.zeros((3, SIZE**3), np.int64)
    for batch in batches:
        for r in batch.to_pylist():
            at = _letters(_unpack_keys(r["keys"]))
            for k, c in enumerate(("n", "t1", "t2")):
                total[k, at] += _unpack(r[c])
    some = np.flatnonzero(total[0])
    for lo in range(0, len(some), 1 << 16):
        at = some[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in total)], ["at", "n", "t1", "t2"])


def _letters(keys: np.ndarray) -> np.ndarray:
    """Place in the table of orders up to three."""
    byte = lambda k: _RANK[((keys >> _U(8 * k)) & _U(0xFF)).astype(np.int64)]
    return (byte(2) * SIZE + byte(1)) * SIZE + byte(0)


def _next(p, seen, context):
    return (seen + SMOOTHING * p) / (context + SMOOTHING)


def short_orders(n: np.ndarray) -> np.ndarray:
    """Probability of every third letter after the two before it, from the counts of all three."""
    c = n.reshape(SIZE, SIZE, SIZE).astype(float)
    p = _next(1 / VOCABULARY, c.sum(axis=(0, 1)), c.sum())
    two = c.sum(axis=0)
    p = _next(p[None], two, two.sum(axis=1, keepdims=True))
    return _next(p[None], c, c.sum(axis=2, keepdims=True)).astype(np.float32).reshape(-1)


def losses(keys: np.ndarray, counts: list[np.ndarray], short: list[np.ndarray]) -> list[np.ndarray]:
    """Loss of each sorted distinct n-gram in nats, for each model; the keys hold all n-grams with their middle bytes."""
    groups = [np.unique(g, return_inverse=True)[1] for g in (keys & _U(0xFFFFFFFF), (keys >> _U(8)) & _U(0xFFFFFF), keys >> _U(8))]
    at = _letters(keys)
    out = []
    for c, table in zip(counts, short):
        seen, context, longest = (np.bincount(g, weights=c)[g] for g in groups)
        p = _next(table[at].astype(float), seen, context)
        out.append(-np.log(_next(p, c, longest)))
    return out


def _sums(batches):
    """(part, keys, counts) of rows (part, ..., keys, n, t1, t2) that come sorted by part, and within it by span."""
    now, held = None, []

    def added():
        return _added(np.concatenate([h[0] for h in held]), *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)))

    for batch in batches:
        for r in batch.to_pylist():
            if now != (own := (r["part"], r.get("span"))):
                if held:
                    yield now[0], *added()
                now, held = own, []
            held.append([_unpack_keys(r["keys"]), *(_unpack(r[c]) for c in ("n", "t1", "t2"))])
            if len(held) == HELD:
                held = [added()]
    if held:
        yield now[0], *added()


def _summed(batches):
    """Rows (part, keys, n, t1, t2) of each span."""
    for part, keys, *n in _sums(batches):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (_pack_keys(keys), *map(_pack, n)))], ["part", "keys", "n", "t1", "t2"])


def _judged(batches, short):
    """Rows (part, known, loss): a part's n-grams and their losses."""
    for part, keys, n, t1, t2 in _sums(batches):
        loss = np.stack(losses(keys, [t1, t2, n], short), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_pack_keys(keys)], pa.binary()), pa.array([_pack_losses(loss)], pa.binary())], ["part", "known", "loss"])


def _answered(batches):
    """Rows (block, keys, loss) from rows (part, span, known, loss, block, keys) sorted by part and span, the losses first."""
    known = loss = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["known"] is not None:
                known, loss = _unpack_keys(r["known"]), _unpack_losses(r["loss"])
                continue
            got = _pack_losses(loss[np.searchsorted(known, _unpack_keys(r["keys"]))])
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int32()), pa.array([r["keys"]], pa.binary()), pa.array([got], pa.binary())], ["block", "keys", "loss"])


def _scored(batches):
    """(doc_id, n, t, b) from rows (block, keys, loss, doc_id, text, half) sorted by block, the n-grams before the texts."""
    now, parts, known, loss = None, [], None, None
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        packed = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (packed[1:] != packed[:-1]), [True]])) if len(blocks) else []
        for a, z in zip(edges[:-1], edges[1:]):
            if blocks[a] != now:
                now, parts, known = blocks[a], [], None
            some = batch.slice(a, z - a)
            if packed[a]:
                parts += zip(some.column(1).to_pylist(), some.column(2).to_pylist())
                continue
            if known is None:
                known, at = np.unique(np.concatenate([_unpack_keys(k) for k, _ in parts] or [np.zeros(0, _U)]), return_index=True)
                loss = np.concatenate([_unpack_losses(x) for _, x in parts] or [np.zeros((0, 3), np.float32)])[at]
                parts = []
            n, sums, half = [], ([], []), some.column(5).to_numpy()
            for lo, hi, buf, off in textops.steps(some.column(4), 1 << 19):
                b, row = tokens(buf, off)
                code = grams(b, row)
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                if len(code) and (not len(known) or (known[at] != code).any()):
                    raise ValueError("the texts are not those that were counted")
                worded = np.bincount(row[b != 0x20], minlength=hi - lo) > 0
                n.append(np.where(worded, np.bincount(row, minlength=hi - lo), 0))
                # The model of the other half, then the background's.
                for k, model in enumerate(((2 - half[lo:hi])[row], 2)):
                    sums[k].append(textops.sum_by_row(loss[at, model].astype(float) if len(code) else np.zeros(0), row, hi - lo))
            join = lambda x, ty: pa.array(np.concatenate(x) if x else np.zeros(0), ty)
            yield pa.RecordBatch.from_arrays([some.column(3), join([x.astype(np.int64) for x in n], pa.int64()), join(sums[0], pa.float64()), join(sums[1], pa.float64())], ["doc_id", "n", "t", "b"])


def lm_score(docs: DataFrame, target_ids: DataFrame, block_bytes: int = BLOCK_BYTES, most_parts: int = MOST_PARTS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every document; ``target_ids`` has doc_id."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # The place of a document depends on its row alone, so that both passes agree; null ids are spread by their texts.
    texts = texts.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    blocks = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes + 1
    parts = min(blocks, most_parts)
    block = lambda key: F.pmod(F.hash(key), F.lit(blocks)).alias("block")
    texts = texts.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int") + 1)
    ids = target_ids.select(F.col("doc_id").cast("long").alias("target")).where("target is not null").select(block("target"), "target")
    flagged = ids.unionByName(texts.select(block("_key"), F.col("doc_id").cast("long"), "text", "half"), allowMissingColumns=True)
    flagged = flagged.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", F.col("target").isNull()).select("block", "target", "doc_id", "text", "half")
    counted = written(spark, flagged.mapInArrow(lambda batches: _counted(batches, parts), "part int, block int, keys binary, n binary, t1 binary, t2 binary"), "lm-counts")
    got = counted.where("part = -1").mapInArrow(_short, "at int, n long, t1 long, t2 long").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", "t1", "t2"))).toArrow()
    short = []
    for c in ("t1", "t2", "n"):
        n = np.zeros(SIZE**3, np.int64)
        n[got["at"].to_numpy()] = got[c].to_numpy()
        short.append(short_orders(n))
    held = spark.sparkContext.broadcast(short)
    spans = (blocks - 1) // SPAN + 1
    asked = counted.where("part >= 0").withColumn("span", F.pmod("block", F.lit(spans)))
    sums = asked.select("part", "span", "keys", "n", "t1", "t2")
    if spans > 1:
        sums = sums.repartition(parts * spans, "part", "span").sortWithinPartitions("part", "span").mapInArrow(_summed, "part int, keys binary, n binary, t1 binary, t2 binary")
    per_part = sums.drop("span").repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(lambda batches: _judged(batches, held.value), "part int, known binary, loss binary")
    told = written(spark, per_part, "lm-losses").select("*", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"))
    rows = told.unionByName(asked.select("part", "span", "block", "keys"), allowMissingColumns=True).select("part", "span", "known", "loss", "block", "keys")
    judged = rows.repartition(parts * spans, "part", "span").sortWithinPartitions("part", "span", F.col("known").isNull()).mapInArrow(_answered, "block int, keys binary, loss binary")
    both = judged.unionByName(texts.select(block("_key"), "doc_id", "text", "half"), allowMissingColumns=True)
    both = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", F.col("keys").isNull()).select("block", "keys", "loss", "doc_id", "text", "half")
    got = both.mapInArrow(_scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, t double, b double")
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return got.select("doc_id", F.col("n").alias("n_tokens"), mean("t").alias("target_loss"), mean("b").alias("background_loss"), (mean("t") - mean("b")).alias("score"))
