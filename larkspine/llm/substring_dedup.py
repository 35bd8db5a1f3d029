"""Substring deduplication by automata of repeated phrases.

Words are runs of characters other than ASCII whitespace, unchanged.  A word goes if one of the windows of ``WINDOW`` words of
its document that cover it also starts in a document with a smaller doc_id; windows are judged on the input.

1. Recurring phrases.  Every window names one of its phrases of ``GRAM`` words, that of the smallest hash, so equal windows
   name the same phrase and neighbours mostly share one.  Phrases that two documents name, and the smallest doc_id that
   names each (its origin), are found by grouping; they are candidates only, so that a collision of hashes costs time, not a result.
2. Passages.  A document is cut into the runs of windows that have one origin.  The origin's own runs are the passages, all others
   are to be searched.
3. Automata.  Passages are dealt by origin to shards of about ``SHARD_BYTES``; an origin that many documents repeat is several
   shards, which share its other documents.  A shard's Aho-Corasick automaton holds every ``PIECE``-th phrase of ``PIECE`` words of
   its passages: any window holds one of them whole.  The runs stream through it, and each window around an occurrence is compared
   with the passages word by word.
4. The rest.  A window that its origin does not hold is in no passage, nor is it in any other document that has it.  Such windows,
   few, are grouped by 128-bit digests.
5. The documents stream by once more with the words that go.

A task holds an automaton, a batch of texts and one document at a time.  Nothing is collected; texts are shuffled twice, compressed.

Defined cases: null and empty texts have no words and give the digest of the empty string.  A null doc_id is neither smaller nor larger
than any: its words stay and cause no removal.  Rows of one doc_id do not remove each other's words; repeated rows give equal
rows.  A text under ``WINDOW`` words stays.  A document that is a copy of one with a smaller doc_id loses all words.  A very long text is
read in steps and its windows are compared in full.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspine.llm import textops
from larkspine.llm.shared import place, written

WINDOW = 13
GRAM = 6
PIECE = (WINDOW + 1) // 2
#: Bits of a phrase's hash.
PHRASE_BITS = 48
#: Bytes of runs of a shard, on average.
SHARD_BYTES = 4 << 20
#: Every byte but ASCII whitespace.
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_RUN = "doc_id long, k1 long, k2 int, start int"


def anchors(hashes: np.ndarray, first: np.ndarray, bits: int = PHRASE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within its row: its row, the place of its first word, the hash of the phrase it names."""
    n = len(hashes)
    if n < WINDOW:
        e = np.zeros(0, np.int64)
        return e, e, e
    low = np.zeros(n - GRAM + 1, _U)
    for k in range(GRAM):
        low = low * _BASE + hashes[k : n - GRAM + 1 + k]
    low = textops.mix(low, 12)
    span, width = WINDOW - GRAM + 1, 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    return row[at], at, (low[at] >> _U(64 - bits)).astype(np.int64)


def _named(batches, bits: int):
    """(a, doc_id): the phrases that each document's windows name, once each."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for lo, _, buf, off in textops.steps(batch.column(1)):
            w = textops.words(buf, off, _WORD, False)
            row, _, a = anchors(w.hash, w.first, bits)
            if len(a):
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
                a, row, _ = textops.distinct_by_row(a[new], row[new])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids[lo:][row])], ["a", "doc_id"])


def _packed(batches):
    """The texts in compressed form, with the row's keys."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        z = [pack((t or "").encode()) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], ["doc_id", "k1", "k2", "z"])


def _emit(rows: list[list], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names)
        for x in rows:
            x.clear()


_RUN_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _runs(batches, bits: int):
    """(lo, doc_id, k1, k2, start, text): the runs of windows of one origin, from rows (doc_id, k1, k2, z, hits of (a, lo))."""
    unpack = zstandard.ZstdDecompressor().decompress
    names, types = ["lo", "doc_id", "k1", "k2", "start", "text"], [pa.int64(), *_RUN_TYPES, pa.binary()]
    rows: list[list] = [[] for _ in names]
    for batch in batches:
        hits = batch.column(4)
        ends = hits.offsets.to_numpy()
        known_all, lo_all = (hits.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        size = 0
        for r, (doc, k1, k2, z) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            data = unpack(z)
            w = textops.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), _WORD, False)
            _, _, a = anchors(w.hash, w.first, bits)
            order = np.argsort(known_all[ends[r] : ends[r + 1]])
            known, low = known_all[ends[r] : ends[r + 1]][order], lo_all[ends[r] : ends[r + 1]][order]
            if not len(a) or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, a), len(known) - 1)
            found = known[at] == a
            origin = low[at]
            edges = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (found[1:] & (origin[1:] != origin[:-1])), [True]]))
            words = data.split()
            for s, e in zip(edges[:-1], edges[1:]):
                if found[s]:
                    text = b" ".join(words[s : e + WINDOW - 1])
                    size += len(text)
                    for x, v in zip(rows, (int(origin[s]), doc, k1, k2, int(s), text)):
                        x.append(v)
            if size > textops.STEP_BYTES << 2:
                yield from _emit(rows, names, types)
                size = 0
        yield from _emit(rows, names, types)


class Automaton:
    """The passages of a shard: the automaton of their pieces, and their words as numbers for comparison."""

    def __init__(self, passages: list[bytes]):
        self.number: dict[bytes, int] = {}
        self.find = ahocorasick.Automaton()
        ids: list[int] = []
        add = self.number.setdefault
        for p in passages:
            words = p.split(b" ")
            for q in range(0, len(words) - PIECE + 1, PIECE):
                self.find.add_word(f" {b' '.join(words[q : q + PIECE]).decode('latin-1')} ", 1)
            ids += [add(w, len(self.number)) for w in words]
            ids.append(-1)
        self.find.make_automaton()
        self.ids = np.array(ids, np.int64)
        start = np.arange(max(0, len(ids) - WINDOW + 1))
        hashed = self._hash(self.ids, start)
        order = np.argsort(hashed, kind="stable")
        self.hashed, self.start = hashed[order], start[order]

    @staticmethod
    def _hash(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        mixed = textops.mix(ids.astype(_U), 3)
        out = np.zeros(len(start), _U)
        for k in range(WINDOW):
            out = out * _BASE + mixed[start + k]
        return out

    def occurrences(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """All words, with a line end as a word between texts, and for each whether a window that a passage holds starts there."""
        text = b" " + b" \n ".join(texts) + b" "
        words = text.split(b" ")[1:-1]
        held = np.zeros(len(words), bool)
        if not len(self.ids) or len(words) < WINDOW:
            return words, held
        space = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
        ends = np.fromiter((e for e, _ in self.find.iter(text.decode("latin-1"))), np.int64)
        piece = np.zeros(len(words) + PIECE + 1, np.int64)
        piece[np.searchsorted(space, ends) - PIECE + 1] = 1  # shifted by one, for the sums
        total = np.cumsum(piece)
        start = np.flatnonzero(total[PIECE : PIECE + len(words)] > total[: len(words)])
        start = start[start <= len(words) - WINDOW]
        get = self.number.get
        ids = np.fromiter((get(w, -2) for w in words), np.int64, len(words))
        hashed = self._hash(ids, start)
        at = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
        same = self.hashed[at] == hashed
        equal = same.copy()
        for k in range(WINDOW):
            equal &= self.ids[self.start[at] + k] == ids[start + k]
        for i in np.flatnonzero(same & ~equal):  # windows of equal hashes and different words
            j = at[i]
            while j < len(self.hashed) and self.hashed[j] == hashed[i] and not equal[i]:
                equal[i] = (self.ids[self.start[j] : self.start[j] + WINDOW] == ids[start[i] : start[i] + WINDOW]).all()
                j += 1
        held[start[equal]] = True
        return words, held


def _located(batches):
    """(doc_id, k1, k2, start, stop, digest) from rows (shard, passage, doc_id, k1, k2, start, text) sorted by shard, passages first:
    words [start, stop) of windows that the origin holds, without a digest, and single windows that it does not hold, with theirs."""
    names, types = ["doc_id", "k1", "k2", "start", "stop", "digest"], [*_RUN_TYPES, pa.int32(), pa.binary()]
    rows: list[list] = [[] for _ in names]
    now, passages, automaton = None, [], None
    for batch in batches:
        shards, first = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (first[1:] != first[:-1]), [True]])) if len(shards) else []
        for a, z in zip(edges[:-1], edges[1:]):
            if shards[a] != now:
                now, passages, automaton = shards[a], [], None
            some = batch.slice(a, z - a)
            if first[a]:
                passages += some.column(6).to_pylist()
                continue
            if automaton is None:
                automaton, passages = Automaton(passages), []
            texts = some.column(6).to_pylist()
            words, held = automaton.occurrences(texts)
            at = 0
            for n, *run, start in zip((t.count(b" ") + 1 for t in texts), *(some.column(c).to_pylist() for c in range(2, 6))):
                own = held[at : at + n - WINDOW + 1]
                edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
                for s, e in edge.reshape(-1, 2):
                    for x, v in zip(rows, (*run, start + int(s), start + int(e) + WINDOW - 1, None)):
                        x.append(v)
                for s in np.flatnonzero(~own):
                    digest = hashlib.blake2b(b" ".join(words[at + s : at + s + WINDOW]), digest_size=16).digest()
                    for x, v in zip(rows, (*run, start + int(s), start + int(s) + WINDOW, digest)):
                        x.append(v)
                at += n + 1
                if len(rows[0]) > 1 << 16:
                    yield from _emit(rows, names, types)
            yield from _emit(rows, names, types)


def _kept(batches):
    """(doc_id, n_words, n_removed, kept_sha256) from rows (doc_id, z, removed of (start, stop))."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for batch in batches:
        out: list[list] = [[], [], []]
        gone = batch.column(2)
        ends, there = gone.offsets.to_numpy(), gone.is_valid().to_numpy(zero_copy_only=False)
        start, stop = (gone.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for r, z in enumerate(batch.column(1).to_pylist()):
            words = unpack(z).split()
            n = len(words)
            if there[r]:
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, start[ends[r] : ends[r + 1]], 1)
                np.add.at(depth, stop[ends[r] : ends[r + 1]], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
            for x, v in zip(out, (n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest())):
                x.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names)


def substring_dedup(docs: DataFrame, shard_bytes: int = SHARD_BYTES, phrase_bits: int = PHRASE_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A row is known by 96 bits of hashes of its id and text.
    keyed = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), "text")
    packed = keyed.mapInArrow(_packed, "doc_id long, k1 long, k2 int, z binary")
    named = rows.where("doc_id is not null and text is not null").mapInArrow(lambda batches: _named(batches, phrase_bits), "a long, doc_id long")
    recurring = written(spark, named.groupBy("a").agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "lo"), "phrases")
    hits = named.join(recurring, "a").groupBy("doc_id").agg(F.collect_set(F.struct("a", "lo")).alias("hits"))
    found = packed.join(hits, "doc_id").select("doc_id", "k1", "k2", "z", "hits").mapInArrow(lambda batches: _runs(batches, phrase_bits), f"lo long, {_RUN}, text binary")
    path = place(spark, "runs")
    found.write.option("compression", "zstd").parquet(path)
    runs = spark.read.schema(found.schema).parquet(path)
    load = runs.groupBy("lo").agg(F.sum(F.octet_length("text")).alias("size"))
    shards = int(load.agg(F.sum("size")).first()[0] or 0) // shard_bytes + 1
    # Origins of more than a shard, a row for each; how many shards they are.
    hot = written(spark, load.where(F.col("size") > shard_bytes).select("lo", F.ceil(F.col("size") / shard_bytes).cast("int").alias("salts")), "origins")
    passage = F.col("lo") == F.col("doc_id")
    salts = F.coalesce("salts", F.lit(1))
    own = F.explode(F.when(passage, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod("k1", salts).cast("int"))))
    dealt = runs.join(hot, "lo", "left").select("*", own.alias("salt"), passage.alias("passage")).withColumn("shard", F.pmod(F.xxhash64("lo", "salt"), F.lit(shards)).cast("int"))
    sorted_ = dealt.repartition(shards, "shard").sortWithinPartitions("shard", ~F.col("passage")).select("shard", "passage", "doc_id", "k1", "k2", "start", "text")
    located = written(spark, sorted_.mapInArrow(_located, f"{_RUN}, stop int, digest binary"), "located")
    rest = located.where("digest is not null")
    again = written(spark, rest.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "lo"), "windows")
    parts = ("k1", "k2", "start", "stop")
    gone = located.where("digest is null").select(*parts).union(rest.join(again, "digest").where("doc_id > lo").select(*parts))
    per_row = gone.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    kept = packed.join(per_row, ["k1", "k2"], "left").select("doc_id", "z", "gone").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return kept.withColumn("doc_id", F.col("doc_id").cast(kind))


SQL = r"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (
        SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
    first_at AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN first_at USING (g), range(13) t(k) WHERE lo < doc_id),
    x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
        FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""
