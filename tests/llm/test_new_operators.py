"""Spelling variants and substring deduplication against plain loops."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from larkspine.llm import spelling_variants, substring_dedup

DOCS = "doc_id long, text string"


def plain_vocabulary(rows, one_in=97):
    n = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(vocabulary):
    near = {w: [v for v in vocabulary if one_edit(v, w)] for w in vocabulary}
    form = {}
    for w in vocabulary:
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 2 * vocabulary[w] else None
    out = {}
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), vocabulary[form[w]] if form[w] else None)
    return out


def variants_of(spark, rows, schema=DOCS, one_in=97):
    got = spelling_variants.spelling_variants(spark.createDataFrame(rows, schema), one_in).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def some_words(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aàbB") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=80))) for i in range(30)]


@pytest.mark.parametrize("one_in", [97, 3, 1])
def test_variants_against_all_pairs(spark, one_in):
    rows = some_words(one_in)
    assert variants_of(spark, rows, one_in=one_in) == plain_variants(plain_vocabulary(rows, one_in))


def test_variants_of_odd_rows(spark):
    long = " ".join(["letter", "lettre", "leter"] * 20_000)
    rows = [(None, "Ünder under ünder"), (1, None), (2, ""), (3, "12 ×× a b"), (4, long), (4, long), (5, "abcde abcdf abcde abcdf abcde abcdf abcd"), (6, "aaaaa aaaaaa " * 3)]
    got = variants_of(spark, rows)
    assert got == plain_variants(plain_vocabulary(rows))
    assert got["abcde"][:2] == (None, "abcde") and got["abcde"][3] == 1


def test_a_prefix_comes_first_among_ties(spark):
    vocabulary = spark.createDataFrame([("house", 3), ("abcdef", 9), ("abcde", 9), ("xbcde", 2), ("houses", 9), ("housé", 9), ("hous", 9)], "word string, n long")
    near = {r.word: r.form for r in spelling_variants.variants(vocabulary).collect()}
    assert near["house"] == "hous" and near["xbcde"] == "abcde" and near["abcde"] is None


def test_roots_of_a_long_chain(spark):
    word, vocabulary = list("abcdefghijklmnopqrst"), {}
    for k in range(20):
        word[k] = "z"
        vocabulary["".join(word)] = 3 * 2**k
    got = {r.word: r.root for r in spelling_variants.variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"z" * 20} and len(got) == 20


def test_variants_in_parts_agree(spark):
    vocabulary = spark.createDataFrame(list(plain_vocabulary(some_words(5), 2).items()), "word string, n long")
    some = sorted(map(tuple, spelling_variants.near_words(vocabulary).collect()))
    assert some == sorted(map(tuple, spelling_variants.near_words(vocabulary, 7).collect())) and some


def test_variants_of_nothing_and_clashing_columns(spark):
    assert variants_of(spark, []) == {}
    rows = [(1, "paper papers paper papers paper papers", "x", 1)]
    assert set(variants_of(spark, rows, "doc_id long, text string, word string, n int")) == {"paper", "papers"}


def plain_dedup(rows):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, texts):
        for i in range(len(w) - 12):
            if d is not None:
                key = tuple(w[i : i + 13])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def dedup_of(spark, rows, schema=DOCS, **more):
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, schema), **more).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got)


def passages(seed, letters=40, docs=60):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(letters)]
    shared = [[rng.choice(words) for _ in range(rng.randint(10, 80))] for _ in range(6)]
    rows = []
    for i in range(docs):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) - 1)
            text += p[a : a + rng.randint(5, 60)] + [rng.choice(words)]
            if rng.random() < 0.3 and text:
                text[rng.randrange(len(text))] = "edit"
        rows.append((i * 7 % docs, rng.choice([" ", "\n", "\t ", "\x0b"]).join(text)))
    return rows


@pytest.mark.parametrize("seed,letters,shard", [(1, 40, 4 << 20), (2, 40, 500), (3, 2, 4 << 20), (4, 2, 300), (5, 1, 300)])
def test_dedup_against_a_loop(spark, seed, letters, shard):
    rows = passages(seed, letters)
    want = plain_dedup(rows)
    assert dedup_of(spark, rows, shard_bytes=shard) == want
    assert sum(n for _, _, n, _ in want) > 100


def test_dedup_of_odd_rows(spark):
    p = " ".join(f"p{k}" for k in range(60))
    q = " ".join(f"q{k % 50}" for k in range(30_000))
    rows = [(1, p), (1, p), (1, "x " + p), (2, p), (2, p), (None, p), (None, "a " * 20), (3, None), (4, ""), (5, " \n "), (6, "z z " * 5 + p.upper()), (7, p.upper() + " tail"), (8, q), (9, q + " q1"), (-4, "lead " + p[:-8]), (10, "a " * 20), (11, "a\na\x0b" * 40)]
    want = plain_dedup(rows)
    assert dedup_of(spark, rows) == want and dedup_of(spark, rows, shard_bytes=64) == want


def test_dedup_of_many_copies_is_split(spark):
    p = " ".join(f"p{k}" for k in range(40))
    rows = [(i, p if i % 3 == 0 else f"own{i} " * 5 + p[20:] + f" {i}") for i in range(300)]
    assert dedup_of(spark, rows, shard_bytes=1000) == plain_dedup(rows)


def test_windows_that_their_origin_lacks(spark):
    """Phrases that collide give candidates whose origin lacks the window: those are grouped by themselves."""
    rows = passages(9)
    assert dedup_of(spark, rows, phrase_bits=3) == plain_dedup(rows)


def test_dedup_of_nothing_and_clashing_columns(spark):
    assert dedup_of(spark, []) == []
    rows = [(1, "a b c " * 9, 1, "x", "y"), (2, "a b c " * 9, None, None, "y")]
    got = dedup_of(spark, rows, "doc_id int, text string, k1 int, lo string, gone string")
    assert got == plain_dedup([r[:2] for r in rows])


def test_anchor_is_shared_by_equal_windows():
    import numpy as np

    h = np.arange(1, 60, dtype=np.uint64)
    _, at, a = substring_dedup.anchors(h, np.array([0, 59]))
    _, at2, a2 = substring_dedup.anchors(h[20:40], np.array([0, 20]))
    assert (a[20 : 20 + len(a2)] == a2).all() and len(at) == 47 and len(at2) == 8


# Samples of the classifiers


def test_samples_keep_their_bound_with_repeated_ids(spark):
    from pyspark.sql import functions as F

    from larkspine.llm import lang_id, quality_fm

    seen = []
    rows = [(7, f"good words number {i} " * 3, "en", 20) for i in range(20_000)] + [(i + 100, f"bad {i} " * 4, "de", 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    labels = spark.createDataFrame([(7, 1)] + [(i + 100, 0) for i in range(300)], "doc_id long, quality int")
    real, quality_fm.train = quality_fm.train, lambda rows: seen.append(len(rows)) or real(rows[:50])
    try:
        quality_fm.fit(docs, labels, sample=500)
    finally:
        quality_fm.train = real
    assert 250 < seen[0] <= 500
    for ids in (F.lit(7).cast("long"), F.lit(None).cast("long")):
        counts = {}
        real, lang_id.train = lang_id.train, lambda c, langs: counts.update({v: langs.count(v) for v in set(langs)}) or real([], [])
        try:
            lang_id.fit(docs.withColumn("doc_id", F.when(F.col("lang") == "en", ids).otherwise(F.col("doc_id"))), 40)
            assert counts == {"en": 40, "de": 40}
            lang_id.fit(docs.withColumn("text", F.lit("one text for all of them")).withColumn("doc_id", ids), 40)
            assert counts == {"en": 1, "de": 1}
        finally:
            lang_id.train = real


# Templates of placeholders


def sums(rng, n):
    return [f"Compute {rng.randint(2, 99)} * {rng.randint(2, 99)} + {rng.randint(100, 999)} - {rng.randint(1000, 9999)}" for _ in range(n)]


def test_arithmetic_with_other_numbers_is_found(spark):
    from larkspine.llm import decontaminate

    rng = random.Random(1)
    items = spark.createDataFrame([(1, "Compute 12 * 45 + 3 - 7"), (2, "Add 3 and 4"), (3, "12 45 3 7"), (4, "Page 7"), (5, "If x is 3 and y is 3 and z is 5 then 3 4 3 5 8 9 is x 4 y z 8 9")], "item_id long, text string")
    docs = {
        1: "Say: Compute 9 * 31 + 8 - 2 now",
        2: "Please add 17 and 29 for me",
        3: "A row of 99 45 3 8 numbers",
        4: "see page 9",
        5: "if x is 6 and y is 6 and z is 1 then 6 2 6 1 7 4 is x 2 y z 7 4",
        6: "if x is 6 and y is 5 and z is 1 then 6 2 5 1 7 4 is x 2 y z 7 4",
        7: "Compute 4 * 4 + 3 - 7",
        8: "The values 12 45 3 7 are given",
        9: "some other text about 3 things and 4 people",
    }
    got = {r.doc_id: r.item_ids for r in decontaminate.decontamination(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), items).collect()}
    assert got[1] == [1] and got[2] == [2] and got[5] == [5] and got[8] == [3]
    assert all(not got[i] for i in (3, 4, 7, 9))
    # Random exercises: each document has one with numbers of its own, or one whose equal values are not those of the item.
    some = sums(rng, 30)
    docs = [(i, f"note {i}: {t}") for i, t in enumerate(some)] + [(100 + i, f"note {i}: Compute {k} * {k} + {k} - {k}") for i, k in enumerate(range(5, 20))]
    got = {r.doc_id: r.contaminated for r in decontaminate.decontamination(spark.createDataFrame(docs, "doc_id long, text string"), items.where("item_id = 1")).collect()}
    assert all(v == (i < 100) for i, v in got.items())


def test_many_items_of_one_template_are_one_pair(spark):
    from larkspine.llm import decontaminate

    rng = random.Random(2)
    text = lambda a, b, c: f"Tom has {a} apples and buys {b} more. He gives {c} of them to a friend. How many apples does he have now in all?"
    values = set()
    while len(values) < 3000:
        values.add(tuple(rng.sample(range(2, 5000), 3)))
    items = [(i, text(*v)) for i, v in enumerate(sorted(values))]
    docs = [(i, f"Exercise. {text(*rng.sample(range(6000, 9000), 3))} End.") for i in range(200)] + [(500, items[1234][1]), (501, "Tom has no apples at all and nothing else")]
    pairs = decontaminate.matched_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = [(r.doc_id, r.item_id) for r in pairs.where("coverage >= 0.5").collect()]
    assert {d for d, _ in found} == {*range(200), 500} and (500, 1234) in found and len(found) < 1000
    assert pairs.count() < 20_000


def test_language_model_parts_are_bounded(spark):
    import numpy as np

    from larkspine.llm import lm_score

    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcdeé ") for _ in range(6)) for _ in range(60))) for i in range(60)]
    docs, good = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    score = lambda **more: {r.doc_id: (r.n_tokens, round(r.score, 6)) for r in lm_score.lm_score(docs, good, **more).collect()}
    assert score() == score(block_bytes=2000, most_parts=3) == score(block_bytes=2000, most_parts=1)
    # What a block exchanges is bounded by the parts, however many blocks there are.
    for n in (1, 4, 16):
        total = 0
        for b in range(n):
            block = lm_score._Block()
            block.add(np.random.default_rng(b).integers(0, 1 << 40, 5000).astype(np.uint64))
            total += len(list(block.rows(b, 8)))
        assert total == 9 * n
