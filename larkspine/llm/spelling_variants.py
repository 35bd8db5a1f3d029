"""Spelling variants: words one edit apart, by rolling-hash deletions.

Words are maximal runs of ``[A-Za-zÀ-ÿ]`` with only A-Z lower-cased, of at least ``LEAST_LENGTH`` code points, that occur
``LEAST_COUNT`` times.  Two words are near if they differ by exactly one inserted, deleted or replaced code point.  A word's form
is its near word of largest count (ties: smallest in code-point order), if that is at least ``RATIO`` times its own; its root is
where its forms lead.

Prefix and suffix polynomial hashes modulo 2**64 give the hash of a word without its i-th character in a step of NumPy for all i: what
stands before it plus what stands behind it, shifted.  A replacement leaves two words equal without the character at one place, an
insertion leaves the longer one equal to the other whole.  Keys are dealt by their high bits (radix) and sorted; runs of
equal keys are compared as strings.  Each run answers with a row per word, the number of its near words there and the best of them,
so no pairs are sent, and a run has at most a word for each place and letter that can be inserted.

Counts double at least with each step to a form, so ``ROUNDS`` doublings of pointers reach every root.

Words are counted where they are read before they are shuffled, so a frequent word is a row a task.  Nothing is collected.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty string in the ids that occurrences
carry; repeated rows count as often as they occur; a very long text is one row's array of words.  Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspine.llm import textops
from larkspine.llm.shared import written

#: The letters of words.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: 2 ** ROUNDS steps are more than a 64-bit count can double.
ROUNDS = 6
#: Keys of a part, on average.
PART_KEYS = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = _U(pow(_BASE, -1, 1 << 64))
_KEYS = "key long, at int, fresh boolean, word string, n long"


def lowered(word: Column) -> Column:
    """A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(word, upper, upper.lower())


def misspelt(doc_id: Column, word: Column, one_in: int = 97) -> Column:
    """The word, without a letter where ``one_in`` divides the crc32 of ``<doc_id>:<word>``; the crc says which."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word), "utf-8"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, word: every run of letters of every text, lower-cased."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("word")).select("doc_id", lowered(F.col("word")).alias("word"))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word whole (at -1) and without each of its characters: key, word's number, place of the character, whether the word differs
    from what it is without the character before."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(_U)
    first = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(codes)) - first[row]
    longest = int(size.max(initial=0)) + 1
    power, inverse = np.ones(longest, _U), np.ones(longest, _U)
    np.cumprod(np.full(longest - 1, _U(_BASE)), out=power[1:])
    np.cumprod(np.full(longest - 1, _INVERSE), out=inverse[1:])
    value = textops.mix(codes, 4)
    # Sums over all words' characters, from which each word's prefix is a difference; each character is weighed by its place in its word.
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(value * power[at])])
    total = sums[first[1:]] - sums[first[:-1]]
    before = sums[:-1] - sums[first[row]]
    behind = total[row] - before - value * power[at]
    without = before + behind * _INVERSE
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    key = np.concatenate([textops.mix(total ^ size.astype(_U)), textops.mix(without ^ (size[row] - 1).astype(_U))])
    return key, np.concatenate([np.arange(len(words)), row]), np.concatenate([np.full(len(words), -1), at]), np.concatenate([np.ones(len(words), bool), ~same])


def _keyed(batches):
    for batch in batches:
        if batch.num_rows:
            key, row, at, fresh = keys(batch.column(0).to_pylist())
            some = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(fresh), *some.columns], ["key", "at", "fresh", "word", "n"])


def _best(rows: list[tuple[str, int]], skip: str) -> tuple[int, str]:
    """Count and word of the largest count, then the first in code-point order."""
    return min(((n, w) for w, n in rows if w != skip), key=lambda x: (-x[0], x[1]))


def _judged(members: list[tuple[int, bool, str, int]], out: list[list]) -> None:
    """Appends (word, near, best_n, best) for the words of one key, members (at, fresh, word, n), that are near others of them."""
    by_text: dict[str, tuple[list, list, dict]] = {}
    for at, fresh, w, n in members:
        text = w if at < 0 else w[:at] + w[at + 1 :]
        whole, longer, replaced = by_text.setdefault(text, ([], [], {}))
        if at < 0:
            whole.append((w, n))
        else:
            if fresh:
                longer.append((w, n))
            replaced.setdefault(at, []).append((w, n))
    for whole, longer, replaced in by_text.values():
        for w, n in longer if whole else ():
            _add(out, w, 1, *reversed(whole[0]))
        for w, n in whole if longer else ():
            _add(out, w, len(longer), *_best(longer, w))
        for some in replaced.values():
            if len(some) > 1:
                n, first = _best(some, "")
                second = _best(some, first)
                for w, _ in some:
                    _add(out, w, len(some) - 1, *(second if w == first else (n, first)))


def _add(out: list[list], *row) -> None:
    for x, v in zip(out, row):
        x.append(v)


def _near(batches):
    """(word, near, best_n, best) from rows of ``_KEYS`` sorted by key."""
    held = None
    out: list[list] = [[], [], [], []]

    def judged(rows: pa.RecordBatch, last: bool):
        """Judges the whole runs of ``rows``; what may go on in the next batch comes back."""
        key = rows.column(0).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        runs = len(edge) - 1 if last else len(edge) - 2
        size = np.diff(edge)[: max(0, runs)]
        for i in np.flatnonzero(size > 1):
            some = rows.slice(edge[i], size[i])
            _judged(list(zip(*(some.column(c).to_pylist() for c in range(1, 5)))), out)
        return rows.slice(edge[runs]) if runs >= 0 else rows

    def emitted():
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "near", "best_n", "best"])
            for x in out:
                x.clear()

    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
        held = judged(batch, False)
        yield from emitted()
    if held is not None:
        judged(held, True)
        yield from emitted()


def near_words(vocabulary: DataFrame, part_keys: int = PART_KEYS) -> DataFrame:
    """word, n_near, best_n, best of the words of ``vocabulary`` (word, n) that have near words."""
    size = vocabulary.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, int(size // part_keys)).bit_length()
    keyed = vocabulary.mapInArrow(_keyed, _KEYS)
    radix = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = keyed.withColumn("radix", radix).repartitionById(1 << bits, F.col("radix")).sortWithinPartitions("key", "word").drop("radix")
    found = dealt.mapInArrow(_near, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top).select("word", "n_near", (-F.col("top.less")).alias("best_n"), "top.best")


def roots(forms: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """word, root of forms (word, form): the last word that forms lead to; words without a form are roots."""
    now = forms
    for _ in range(rounds):
        step = now.select(F.col("word").alias("form"), F.col("form").alias("next"))
        now = written(forms.sparkSession, now.join(step, "form", "left").select("word", F.coalesce("next", "form").alias("form")), "forms")
    return now.withColumnRenamed("form", "root")


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root for the words of ``vocabulary`` (word, n)."""
    near = vocabulary.join(near_words(vocabulary), "word", "left")
    led = F.col("best_n") >= F.col("n") * ratio
    judged = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n"))
    judged = written(vocabulary.sparkSession, judged, "variants")
    led_to = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(led_to, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, one_in: int = 97) -> DataFrame:
    """variants() of the words of docs (doc_id, text); one occurrence in ``one_in`` loses a letter, as ``misspelt`` says."""
    words = occurrences(docs).select(misspelt(F.col("doc_id"), F.col("word"), one_in).alias("word"))
    vocabulary = written(docs.sparkSession, counted(words), "vocabulary")
    return variants(vocabulary)
