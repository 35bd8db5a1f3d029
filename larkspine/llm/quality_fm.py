"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score of a document with features x: ``w0 + sum(w*x) + 1/2 sum_f((sum v_f*x)^2 - sum v_f^2*x^2)``,
through a logistic; the identity makes it linear in the number of features.  The machine is
trained on the driver from a bounded sample of labelled rows (``sample`` rows at most, drawn by a hash of
doc_id); what is collected per row is its feature vector, of at most ``BUCKETS`` entries of 6 bytes (98 kB
a row, 590 MB for 6000 rows that each hold every bucket; texts of 2 kB give about 1 kB a row).
Scoring reads whole texts, row by row, without a shuffle, and what it holds of a long text is a few times its size.

Defined cases: null or empty texts score like any text without words; ``n_chars`` that is null, or a table without
it, is taken as the text's number of code points; labels that are null are left out, and of several labels of a document the
lowest counts; without both labels every score is the prior.  A score of exactly ``THRESHOLD`` is accepted.  Repeated rows
score alike, and each row with a labelled doc_id is learned from.  Extra columns are ignored; ``keep_good`` passes them through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspine.llm import textops

BUCKETS = 1 << 14
STATS = 14
FACTORS = 8
THRESHOLD = 0.7


@dataclass
class FactorMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def features(texts: pa.Array, n_chars: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per step of the texts: (word bucket, weight, row within the step), and the statistics as rows x STATS."""
    given = np.asarray(n_chars.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False))
    out = []
    for lo, hi, buf, off in textops.steps(texts):
        rows = hi - lo
        w = textops.words(buf, off)
        bucket = (w.hash >> np.uint64(64 - 14)).astype(np.int64)
        b, row, count = textops.distinct_by_row(bucket, w.row)
        n_words = np.maximum(w.counts, 1)
        weight = np.sqrt(count / n_words[row])
        size = np.maximum(np.diff(off), 1).astype(float)
        share = lambda mask: textops.count_by_row(mask, off) / size  # noqa: E731, B023
        _, drow, dcount = textops.distinct_by_row(w.hash, w.row)
        kinds = np.bincount(drow, minlength=rows)
        top = np.zeros(rows)
        np.maximum.at(top, drow, dcount.astype(float))
        length = (w.end - w.start).astype(float)
        mean_len = textops.sum_by_row(length, w.row, rows) / n_words
        same = np.zeros(len(w.hash))
        if len(w.hash) > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        pairs = (w.hash[:-1] * np.uint64(3) + w.hash[1:])[w.row[:-1] == w.row[1:]] if len(w.hash) > 1 else w.hash[:0]
        prow = w.row[:-1][w.row[:-1] == w.row[1:]] if len(w.hash) > 1 else w.row[:0]
        _, qrow, _ = textops.distinct_by_row(pairs, prow)
        n_pairs = np.maximum(np.bincount(prow, minlength=rows), 1)
        stats = np.stack(
            [
                share((buf >= 0x41) & (buf <= 0x5A)),
                share((buf >= 0x30) & (buf <= 0x39)),
                share((buf < 0x80) & ~textops.WORD_BYTE[buf] & (buf > 0x20)),
                share((buf == 0x23) | (buf == 0x24) | (buf == 0x25) | (buf == 0x26) | (buf == 0x2A)),
                share((buf == 0x7C) | (buf == 0x7B) | (buf == 0x7D) | (buf == 0x3C) | (buf == 0x3E)),
                share(buf == 0x21),
                share((buf == 0x2E) | (buf == 0x2C)),
                share(buf == 0x0A),
                kinds / n_words,
                np.bincount(qrow, minlength=rows) / n_pairs,
                top / n_words,
                textops.sum_by_row(same, w.row, rows) / n_words,
                mean_len,
                np.log1p(np.where(given[lo:hi] >= 0, given[lo:hi], textops.count_by_row((buf & 0xC0) != 0x80, off))),
            ],
            axis=1,
        )
        out.append((b, weight, row, stats))
    return out


def _forward(m: FactorMachine, b: np.ndarray, x: np.ndarray, row: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(stats)
    z = np.clip((stats - m.mean) / m.scale, -4, 4)
    total = m.bias + textops.sum_by_row(m.linear[b] * x, row, rows) + z @ m.linear[BUCKETS:]
    sums = np.empty((rows, m.factors.shape[1]))
    for f in range(m.factors.shape[1]):
        v = m.factors[:, f]
        vx = v[b] * x
        sums[:, f] = textops.sum_by_row(vx, row, rows) + z @ v[BUCKETS:]
        total += 0.5 * (sums[:, f] ** 2 - textops.sum_by_row(vx * vx, row, rows) - (z * z) @ (v[BUCKETS:] ** 2))
    return total, sums


def _logistic(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -35, 35)))


def gradients(m: FactorMachine, b: np.ndarray, x: np.ndarray, row: np.ndarray, stats: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss of a batch, by bias, linear weights and factors."""
    z = np.clip((stats - m.mean) / m.scale, -4, 4)
    total, sums = _forward(m, b, x, row, stats)
    g = (_logistic(total) - y) / len(y)
    linear = np.bincount(b, g[row] * x, minlength=len(m.linear))
    linear[BUCKETS:] += z.T @ g
    factors = np.empty_like(m.factors)
    for f in range(m.factors.shape[1]):
        v = m.factors[:, f]
        factors[:, f] = np.bincount(b, g[row] * x * (sums[row, f] - v[b] * x), minlength=len(v))
        factors[BUCKETS:, f] += (z * sums[:, f : f + 1] - z * z * v[BUCKETS:]).T @ g
    return float(g.sum()), linear, factors


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.08, l2: float = 2e-5, seed: int = 7) -> FactorMachine:
    """Adagrad over (buckets, weights, statistics, label) of each row."""
    rng = np.random.default_rng(seed)
    d = BUCKETS + STATS
    y = np.array([r[3] for r in rows], float)
    prior = (y.sum() + 1) / (len(y) + 2)
    m = FactorMachine(float(np.log(prior / (1 - prior))), np.zeros(d), rng.normal(0, 0.02, (d, FACTORS)), np.zeros(STATS), np.ones(STATS))
    if not len(y) or y.min() == y.max():
        m.factors[:] = 0
        return m
    stats = np.stack([r[2] for r in rows])
    m.mean, m.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    seen_w, seen_v = np.full(d, 1e-4), np.full((d, FACTORS), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            b = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            by_bias, by_linear, by_factors = gradients(m, b, x, row, stats[part], y[part])
            m.bias -= rate * by_bias
            by_linear += l2 * m.linear
            seen_w += by_linear**2
            m.linear -= rate * by_linear / np.sqrt(seen_w)
            by_factors += l2 * m.factors
            seen_v += by_factors**2
            m.factors -= 0.25 * rate * by_factors / np.sqrt(seen_v)
    return m


def _length(docs: DataFrame, text: str) -> Column:
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length(text).cast("long")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", training: Column | None = None, sample: int = 6000) -> FactorMachine:
    """Trains on at most ``sample`` labelled rows for which ``training`` (of doc_id) holds: ids are drawn by a hash, and of their rows, however many
    have one id, those of the smallest hashes of id and text."""
    spark = docs.sparkSession
    mine = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    mine = mine.where(training) if training is not None else mine
    mine = mine.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    n = mine.count()
    place = F.pmod(F.xxhash64(F.lit("fm"), "doc_id"), F.lit(1 << 20))
    some = mine.where(place < int(min(1.0, sample / max(n, 1)) * (1 << 20))) if n > sample else mine
    picked = {r["doc_id"]: int(r["y"]) for r in some.collect()}
    if not picked:
        return train([])
    known = spark.sparkContext.broadcast(picked)

    def pick(batches):
        import numpy as np

        for batch in batches:
            ids = batch.column(0).to_pylist()
            keep = [i for i, k in enumerate(ids) if k in known.value]
            if not keep:
                continue
            part = batch.take(pa.array(keep))
            at, done, draw = 0, [], part.column(3).to_pylist()
            for b, x, row, stats in features(part.column(1), part.column(2)):
                edge = np.searchsorted(row, np.arange(len(stats) + 1))
                for i in range(len(stats)):
                    s = slice(edge[i], edge[i + 1])
                    done.append((draw[at], ids[keep[at]], b[s].astype(np.int16).tobytes(), x[s].astype(np.float32).tobytes(), stats[i].tobytes()))
                    at += 1
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in done], pa.int64()) for k in (0, 1)), *(pa.array([r[k] for r in done], pa.binary()) for k in (2, 3, 4))], ["draw", "doc_id", "b", "x", "s"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _length(docs, "text"), F.xxhash64(F.lit("fm"), "doc_id", "text").alias("draw"))
    got = rows.mapInArrow(pick, "draw long, doc_id long, b binary, x binary, s binary").orderBy("draw").limit(sample).collect()
    rows = [(np.frombuffer(r["b"], np.int16).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float), np.frombuffer(r["s"], float), picked[r["doc_id"]]) for r in sorted(got, key=lambda r: (r["doc_id"], bytes(r["s"]), bytes(r["b"])))]
    return train(rows)


def score_column(spark: SparkSession, model: FactorMachine, docs: DataFrame, text: str = "text") -> Column:
    """The score (0 to 1) of each row of ``docs`` as a column, from text and n_chars only."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array, n_chars: pa.Array) -> pa.Array:
        out = [_logistic(_forward(held.value, b, x, row, stats)[0]) for b, x, row, stats in features(texts, n_chars)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(F.col(text).cast("string"), _length(docs, text))


def held_out(of: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(of).cast("string")), F.lit(4)) == 2


def training_rows() -> Column:
    return F.coalesce(~held_out(), F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, training=training_rows(), sample=sample)
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(docs.sparkSession, model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    model = fit(docs, labels, training=training_rows(), sample=sample)
    return docs.where(score_column(docs.sparkSession, model, docs) >= THRESHOLD)
