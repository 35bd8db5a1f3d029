"""Language identification: averaged embeddings of hashed subwords with a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of the text, case folded, with everything that isn't part
of a word as a space; each is hashed to one of ``BUCKETS`` embeddings.  A text's vector is the mean of
its subwords' embeddings and a linear softmax gives the languages.  Embeddings and softmax are
trained together by stochastic gradient descent (Adagrad) in numpy, ``ROUNDS`` times over a bounded sample: ``PER_LANG``
labelled rows of each of at most ``MOST_LANGS`` languages, drawn by a hash of doc_id and text, whole texts.  What is collected of a row is its subword counts, of at
most ``BUCKETS`` entries of 6 bytes.  A fifth of the sample is set
aside for calibration: a temperature that makes the probabilities honest, and the rejection threshold,
the lowest at which accepted predictions of that part reach ``PRECISION``.

Since mean and softmax input are linear, the trained embeddings fold into one score per bucket and
language, so prediction is a table lookup per byte position of the whole text, without a shuffle.  A text
is looked up in pieces of ``PIECE`` bytes, so memory does not follow its length.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and rejected; so is every text if no row
has a language to learn from; null languages are not learned.  Ties go to the language that sorts first.  Repeated rows are
predicted alike, each row by itself, and count once in the sample.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspine.llm import textops

BITS = 15
BUCKETS = 1 << BITS
DIM = 16
ORDERS = (2, 3, 4)
PER_LANG = 300
#: Languages that are learned at most, the most frequent ones.
MOST_LANGS = 1000
ROUNDS = 8
BATCH = 32
PIECE = 1 << 17
PRECISION = 0.995
UNKNOWN = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray = field(repr=False)  # (BUCKETS + 1) x languages; the last row is zero
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    threshold: float = 0.0


def plain(buf: np.ndarray) -> np.ndarray:
    """Case folded, with spaces for what isn't part of a word."""
    b = textops.fold(buf)
    return np.where(textops.WORD_BYTE[b], b, 0x20).astype(np.uint8)


def subwords(plain_bytes: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram at every byte; BUCKETS where it would leave its row."""
    b = plain_bytes.astype(np.uint32)
    n = len(b)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    out, code = [], b.copy()
    for k in range(2, max(ORDERS) + 1):
        code = code * np.uint32(0x01000193)
        code[: n - k + 1] += b[k - 1 :]
        if k in ORDERS:
            h = code * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
            out.append(np.where(left >= k, h, BUCKETS).astype(np.int64))
    return out


def pieces(buf: np.ndarray, off: np.ndarray):
    """(first byte, offsets of the rows, subwords that begin there) over pieces of a step."""
    b, reach = plain(buf), max(ORDERS) - 1
    for a in range(0, len(b), PIECE):
        z = min(a + PIECE + reach, len(b))
        here = min(PIECE, len(b) - a)
        yield a, np.clip(off - a, 0, here), [g[:here] for g in subwords(b[a:z], np.clip(off - a, 0, z - a))]


def logits(texts: pa.Array, model: LanguageModel) -> np.ndarray:
    parts = []
    for lo, hi, buf, off in textops.steps(texts):
        total, n = np.zeros((hi - lo, len(model.langs))), np.zeros(hi - lo)
        for _, edge, orders in pieces(buf, off):
            full = np.flatnonzero(np.diff(edge) > 0)
            for grams in orders:
                total[full] += np.add.reduceat(model.table[grams], edge[full], axis=0)
                n[full] += np.add.reduceat((grams < BUCKETS).astype(float), edge[full])
        parts.append(total / np.maximum(n, 1)[:, None] + model.bias)
    return np.concatenate(parts) if parts else np.zeros((0, len(model.langs)))


def shares(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and the share of its subwords that each has."""
    out = []
    for lo, hi, buf, off in textops.steps(texts):
        rows = [[] for _ in range(hi - lo)]
        for _, edge, orders in pieces(buf, off):
            for r in np.flatnonzero(np.diff(edge) > 0):
                g = np.concatenate([x[edge[r] : edge[r + 1]] for x in orders])
                rows[r].append(np.unique(g[g < BUCKETS], return_counts=True))
        for parts in rows:
            b, at = np.unique(np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)]), return_inverse=True)
            c = np.bincount(at, np.concatenate([p[1] for p in parts] or [np.zeros(0)]), minlength=len(b))
            out.append((b, c / max(1.0, c.sum())))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(counts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, emb: np.ndarray, soft: np.ndarray, bias: np.ndarray):
    """Of the mean cross entropy of a batch: (touched buckets, by their embeddings, by the softmax, by its bias)."""
    b = np.concatenate([c[0] for c in counts])
    x = np.concatenate([c[1] for c in counts])
    row = np.repeat(np.arange(len(counts)), [len(c[0]) for c in counts])
    hidden = np.stack([np.bincount(row, emb[b, f] * x, minlength=len(counts)) for f in range(emb.shape[1])], axis=1)
    g = _softmax(hidden @ soft + bias)
    g[np.arange(len(counts)), y] -= 1
    g /= len(counts)
    back = g @ soft.T
    touched, where = np.unique(b, return_inverse=True)
    ge = np.stack([np.bincount(where, back[row, f] * x, minlength=len(touched)) for f in range(emb.shape[1])], axis=1)
    return touched, ge, hidden.T @ g, g.sum(0)


def train(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], rate: float = 0.5, seed: int = 11) -> LanguageModel:
    """Trains on the subword shares of each text."""
    names = sorted(set(langs))
    k = len(names)
    if not k:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    y = np.array([names.index(v) for v in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(counts))
    aside, used = order[: len(order) // 5], order[len(order) // 5 :]
    emb, soft, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, k)), np.zeros(k)
    seen_e, seen_s, seen_b = np.full((BUCKETS, DIM), 1e-6), np.full((DIM, k), 1e-6), np.full(k, 1e-6)
    for _ in range(ROUNDS):
        used = rng.permutation(used)
        for at in range(0, len(used), BATCH):
            part = used[at : at + BATCH]
            touched, ge, gs, gb = gradients([counts[i] for i in part], y[part], emb, soft, bias)
            seen_e[touched] += ge**2
            seen_s += gs**2
            seen_b += gb**2
            emb[touched] -= 0.2 * rate * ge / np.sqrt(seen_e[touched])
            soft -= 0.2 * rate * gs / np.sqrt(seen_s)
            bias -= 0.1 * rate * gb / np.sqrt(seen_b)
    model = LanguageModel(names, np.vstack([emb @ soft, np.zeros(k)]), bias)
    if len(aside):
        z = np.stack([counts[i][1] @ model.table[counts[i][0]] for i in aside]) + bias
        # One error more than was seen, spread over the languages, so that a perfect part gives no certainty.
        want = np.full(z.shape, 1 / (k * (len(aside) + 1)))
        want[np.arange(len(aside)), y[aside]] += 1 - want.sum(axis=1)
        loss = {t: -(want * np.log(np.maximum(_softmax(z / t), 1e-300))).sum(axis=1).mean() for t in np.geomspace(0.05, 5, 40)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        top, right = p.max(1), p.argmax(1) == y[aside]
        by = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= PRECISION)
        model.threshold = float(top[by][good[-1]]) if len(good) else 1.0
    return model


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, training: Column | None = None) -> LanguageModel:
    """Trains on ``per_lang`` distinct rows of each of the ``MOST_LANGS`` most frequent languages, or all there are: those of the smallest
    hashes of id and text among the rows for which ``training`` holds."""
    mine = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (training if training is not None else F.lit(True)))
    mine = mine.select("lang", F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit("lang"), "doc_id", "text").alias("draw"))
    langs = mine.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).select("lang")
    # Each task keeps the first hashes of each language, so the ranking gets few rows; equal rows have one rank.
    first = mine.select("lang", "draw").withColumn("rank", F.dense_rank().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("rank") <= per_lang)
    cuts = first.groupBy("lang").agg(F.max("draw").alias("cut")).join(F.broadcast(langs), "lang", "left_semi")
    picked = mine.join(F.broadcast(cuts.limit(MOST_LANGS)), "lang").where(F.col("draw") <= F.col("cut")).dropDuplicates(["lang", "draw"]).select("lang", "doc_id", "text")

    def counted(batches):
        for batch in batches:
            got = shares(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.astype(np.int16).tobytes() for b, _ in got], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in got], pa.binary())], ["lang", "doc_id", "b", "c"])

    rows = picked.mapInArrow(counted, "lang string, doc_id string, b binary, c binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"] or "", bytes(r["b"]), bytes(r["c"])))
    return train([(np.frombuffer(r["b"], np.int16).astype(np.int64), np.frombuffer(r["c"], np.float32).astype(float)) for r in rows], [r["lang"] for r in rows])


def language_id(docs: DataFrame, model: LanguageModel | None = None, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every document."""
    model = model or fit(docs, per_lang, ~held_out())
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<lang:string,score:double>"

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        m = held.value
        if not m.langs:
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))], ["lang", "score"])
        p = _softmax(logits(texts, m) / m.temperature)
        return pa.StructArray.from_arrays([pa.array([m.langs[i] for i in p.argmax(1)], pa.string()), pa.array(p.max(1))], ["lang", "score"])

    text = F.col("text").cast("string")
    got = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), predict(text).alias("p"))
    return got.select(
        "doc_id",
        "held_out",
        F.when(F.col("letters"), F.col("p.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.least(F.col("p.score"), F.lit(1.0))).otherwise(0.0).alias("score"),
        (F.col("letters") & (F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= model.threshold)).alias("accepted"),
    )
