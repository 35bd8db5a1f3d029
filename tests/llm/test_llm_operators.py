"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with the odd cases."""

import hashlib
import io
import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspine.llm import decontaminate, exact_dedup, lang_id, license_scan, lm_score, mixing, ngram_join, quality_fm, textops, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "null id", None, None, None), (901, None, None, None, None), (902, "", "en", "", 0), (903, " \n\t", "en", "s", 3), (904, "word " * 30_000, "en", "s", None), (905, "a", "de", None, 1), (905, "a", "de", None, 1)]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"text_sha256": F.lit(1), "rep": F.lit("x"), "size": F.lit("y"), "score": F.lit(2), "keep_id": F.lit(0)}) if extra else df


# Text routines


def test_words_match_a_plain_scan():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB c9_ÀéЖ\n.,") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, ""]
    got = []
    for lo, hi, buf, off in textops.steps(pa.array(texts), 200):
        w = textops.words(buf, off)
        got += [[bytes(textops.fold(buf)[a:b]).decode() for a, b, r in zip(w.start, w.end, w.row) if r == k] for k in range(hi - lo)]
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in t)
    assert got == [re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", fold(t or "")) for t in texts]


def test_window_hashes_depend_on_words_alone():
    sets = {}
    for text in ("a b c d e f", "x y a b c d e f z", "A, b c  d e f", "c d", "C d", ""):
        (_, _, buf, off) = next(textops.steps(pa.array([text])))
        w = textops.words(buf, off)
        sets[text] = set(textops.windows(w.hash, w.first, 5)[0].tolist())
    assert len(sets["a b c d e f"]) == 2 and sets["a b c d e f"] == sets["A, b c  d e f"] < sets["x y a b c d e f z"]
    assert sets["c d"] == sets["C d"] and len(sets["c d"]) == 1 and not sets[""]


# 10 Exact dedup


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_dedup(spark, extra):
    rng = random.Random(2)
    base = [words(rng, 8) for _ in range(20)]
    rows = [(i, rng.choice(base).replace(" ", rng.choice([" ", "  ", "\n", ""])), "en", "s", 0) for i in range(-50, 150)] + ODD
    df = frame(spark, rows, extra).repartition(7)
    got = exact_dedup.exact_dedup(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_dedup([(r[0], r[1]) for r in rows])
    kept = exact_dedup.keep_distinct(df)
    assert kept.columns == df.columns and kept.count() == len({r[4] for r in brute_dedup([(r[0], r[1]) for r in rows])})


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# 9 Mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, todo = 1.5 * sum(sizes.values()), {}, set(names)
    while todo:
        level = left / sum(weight[s] for s in todo)
        full = {s for s in todo if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in todo}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        todo -= full
    return out


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([1, 5, 20, 80])), "en", rng.choice(["hot"] * 5 + ["a", "b", "ü", None, "z"]), 0) for i in range(1500)] + ODD
    df = frame(spark, rows, True)
    got = mixing.mix(df, block=100).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and all(r["source_size"] == sizes[s] for r in got if r["source"] == s)
        if sizes[s] > 2000 and s != "s":
            assert taken[s] == pytest.approx(want[s], rel=0.01)
    again = mixing.mix(df.repartition(5), block=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_multipliers_close_the_dual(spark):
    """Expected words equal the targets, and the rates solve the dual that bisection solves."""
    rng = random.Random(91)
    sizes = {"a": 50_000, "b": 300, "c": 7, None: 4000, "one": 1}
    hist = [(s, size, rng.randint(1, 9)) for s, n in sizes.items() for size in sorted({rng.randint(1, 40) for _ in range(30)} if n > 1 else {11})]
    h = spark.createDataFrame(hist, "source string, size long, n long")
    words = {s: sum(size * n for k, size, n in hist if k == s) for s in sizes}
    share = {"a": 0.3, "b": 1.9999, "c": 0.001, None: 1.5, "one": 1.2}
    wanted = spark.createDataFrame([(s, words[s], share[s] * words[s]) for s in sizes], "source string, source_size long, target double")
    got = {r["source"]: r for r in mixing.balance(h, wanted).collect()}
    assert set(got) == set(sizes)
    base = np.log(1.5 / 0.5)
    for s, r in got.items():
        size, n = (np.array([x[k] for x in hist if x[0] == s], float) for k in (1, 2))
        mean = words[s] / n.sum()
        assert r["mean"] == pytest.approx(mean)
        have = lambda lam: (n * size * 2 / (1 + np.exp(-np.clip(base + lam * size / mean, -60, 60)))).sum()  # noqa: E731, B023
        assert have(r["lam"]) == pytest.approx(share[s] * words[s], rel=2e-7, abs=2e-7)
        lo, hi = -1e4, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if have(mid) < share[s] * words[s] else (lo, mid)
        rates = [2 / (1 + np.exp(-(base + lam * size / mean))) for lam in (r["lam"], lo)]
        assert np.allclose(*rates, atol=1e-5)
    with pytest.raises(RuntimeError):
        mixing.balance(h, wanted, steps=2)


def test_mixing_without_rows_and_without_words(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()] == [0, 0]


# 3 N-gram Jaccard join


def brute_links(rows, threshold=0.8):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", fold(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    return sets, links


@pytest.mark.parametrize("block,small", [(512, 256), (8, 6)])
def test_ngram_join_finds_every_link(spark, monkeypatch, block, small):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SAMPLES_BLOCK", block)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rng = random.Random(4)
    rows, passage = [], words(rng, 12)
    for g in range(12):
        w = words(rng, rng.choice([5, 30, 120])).split()
        for _ in range(rng.choice([1, 2, 3, 25])):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2])):
                v[rng.randrange(len(v))] = words(rng, 1)
            rows.append((len(rows), " ".join(v) + ("" if g % 3 else " " + passage), "en", "s", 0))
    rows += [(200 + i, passage + " " + words(rng, 60), "en", "s", 0) for i in range(40)] + [(300, "one two", "", "", 0), (301, "One, two!", "", "", 0), (302, "", "", "", 0), (303, None, "", "", 0)]
    _, links = brute_links([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(frame(spark, rows, True).repartition(5)).collect()}
    assert len(got) == len(rows)
    n = {r[0]: 0 for r in rows}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        n[a] += 1
        n[b] += 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: r["n_links"] for i, r in got.items()} == n
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in n}


def test_ngram_join_recall_in_wide_buckets(spark, monkeypatch):
    """Every document holds one of two common passages; pairs lie just above the threshold."""
    monkeypatch.setattr(ngram_join, "SMALL", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    monkeypatch.setattr(ngram_join, "SAMPLES_BLOCK", 64)
    rng = random.Random(31)
    passages, rows = [words(rng, 45) for _ in range(2)], []
    for i in range(300):
        own = words(rng, 55).split()
        near = own[:53] if i % 2 else [*own[:20], words(rng, 1), *own[21:]]
        rows += [(len(rows) + k, passages[i % 2] + " " + " ".join(t), "en", "s", 0) for k, t in enumerate((own, near))]
    _, links = brute_links([(r[0], r[1]) for r in rows])
    assert len(links) >= 290
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert sum(got.values()) == 2 * len(links)
    assert ngram_join.missed() < 1 - ngram_join.RECALL


def test_ngram_join_odd_rows(spark):
    got = ngram_join.ngram_join(frame(spark, ODD, True)).collect()
    assert len(got) == len(ODD) and all(r["n_links"] == 0 and r["class_id"] == r["doc_id"] for r in got)
    kept = ngram_join.keep_one(frame(spark, [*ODD, (10, "a b c d e f g", "", "", 0), (11, "A b c d e f g!", "", "", 0)], True))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["10", *(str(r[0]) for r in ODD)])
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0


# 5 Decontamination


FRUIT = "take 5 apples then add 5 pears and take 5 plums then add 5 figs now"
ITEM = "A train leaves the station at 60 km per hour and Anna waits for 3 hours. How far does Anna see the train go after 3 hours?"


@pytest.mark.parametrize(
    "text,bad",
    [
        (ITEM, True),
        ("Before. " + ITEM + " After it.", True),
        (ITEM.replace("60", "85").replace("3", "7").replace("Anna", "Bob").replace("km", "miles"), True),
        ("take 5 apples then add 5 pears and take 5 plums then add 5 figs now", True),
        ("take 6 apples then add 6 pears and take 6 plums then add 6 figs now", True),
        ("take 5 apples then add 6 pears and take 7 plums then add 8 figs now", False),
        ("A train leaves. " + "The weather in the hills is good today and nobody waits. " * 5, False),
        ("", False),
        (None, False),
        ("7 8 9 10 11 12 13 14 15 16", False),
    ],
)
def test_decontamination(spark, text, bad):
    items = spark.createDataFrame([(1, ITEM), (2, None), (None, ITEM), (3, ""), (4, "1 2 3 4 5 6 7 8 9"), (5, FRUIT)], "item_id long, text string")
    docs = frame(spark, [(7, text, "en", "s", 0), *ODD], True)
    got = {r["doc_id"]: r for r in decontaminate.decontamination(docs, items).collect()}
    assert got[7]["contaminated"] == bad and got[7]["item_ids"] == ([5 if text.startswith("take") else 1] if bad else [])
    assert not any(r["contaminated"] for i, r in got.items() if i != 7)
    assert decontaminate.keep_clean(docs, items).count() == len(ODD) + (not bad)
    assert decontaminate.keep_clean(frame(spark, [(None, text, "en", "s", 0), (None, "other", "en", "s", 0), (7, "other", "en", "s", 0)]), items).count() == 2 + (not bad)


def flagged(spark, items, texts):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    return [r["item_ids"] for r in sorted(decontaminate.decontamination(docs, items).collect(), key=lambda r: r["doc_id"])]


def test_decontamination_unites_alignments_and_finds_long_excerpts(spark):
    rng = random.Random(51)
    w, long, other = (words(rng, n).split() for n in (48, 300, 200))
    item = "the clerk told Bob to count 25 boxes while the manager asked Bob for 25 labels and then went home with Bob at noon"
    again = item.replace("Bob", "Ann Lee").replace("25", "twenty five")
    texts = [" ".join([*w[:16], "extra", *w[16:32], "again", *w[32:]]), " ".join([*w[:16], *w[18:33], *w[34:]]), again, again.replace("twenty five labels", "thirty labels"), " ".join(other[:90] + long[100:220] + other[90:]), " ".join(other + long[:30])]
    assert flagged(spark, [" ".join(w), " ".join(long), item], texts) == [[0], [0], [2], [2], [1], []]
    assert flagged(spark, ["the clerk told Bob and then asked Bob and later met Bob at noon"], ["the clerk told Al and then asked Cy and later met Di at noon"]) == [[]]


def test_decontamination_finds_copies_without_template_words(spark):
    items = ["Compute 12 + 35 * 4 - 18 / 3", "7 + 5 = 12", "Invite Anna, Bob, Carol, Dave, Erin, Frank, Grace, Heidi", "Paris"]
    texts = ["Next: compute 12 + 35 * 4 - 18 / 3 by hand", "we know that 7 + 5 = 12 holds", "so invite Anna, Bob, Carol, Dave, Erin, Frank, Grace, Heidi today", "Compute 13 + 36 * 5 - 19 / 4", "8 + 5 = 13", "in Paris", "paris!"]
    assert flagged(spark, items, texts) == [[0], [1], [2], [0], [], [], [3]]  # the fourth is the first exercise with other numbers


def test_decontamination_takes_first_words_as_names_and_ignores_case(spark):
    first = "Alice has 3 apples. Bob gives 4 more. Alice eats 2 of them. Bob then takes 5 away. Alice counts them all again."
    again = first.replace("Alice", "Mary Ann").replace("Bob", "Carl").replace("3", "6")
    texts = [again, again.replace("Carl then", "Dora then").replace("Mary Ann eats", "Eve eats").replace("Mary Ann counts", "Fay counts"), ITEM.lower(), ITEM.upper(), ITEM.replace(".", "").replace("60", "80"), "and then Mary walks to the old market"]
    assert flagged(spark, [first, ITEM, "Bob walks to the old market"], texts) == [[0], [], [1], [1], [1], [2]]


def test_decontamination_windows_against_brute_force(spark):
    """Random templates: what windows match, and how much of an item a single alignment covers."""
    rng = random.Random(52)
    names, common = ["Anna", "Bob", "Carl", "Dora"], [words(rng, 1) for _ in range(12)]

    def text(n):
        return " ".join(rng.choice([rng.choice(names), str(rng.randint(1, 30)), *[rng.choice(common)] * 3]) for _ in range(n))

    items = [text(rng.randint(1, 30)) for _ in range(40)]
    docs = [text(rng.randint(0, 40)) for _ in range(30)] + [text(5) + " " + i + " " + text(5) for i in items[:20]] + ["", "one"]
    pairs = decontaminate.matched_pairs(frame(spark, [(d, t, "en", "s", 0) for d, t in enumerate(docs)]), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in pairs}
    views = lambda t: decontaminate.templates(*next(textops.steps(pa.array([t])))[2:]) if t else None
    for d, doc in enumerate(docs):
        mine = views(doc)
        for i, item in enumerate(items):
            theirs, hit = views(item), False
            for v in range(decontaminate.VIEWS) if mine else []:
                x, y = theirs[v].token.tolist(), mine[v].token.tolist()
                slot = theirs[v].slot.tolist()
                size = min(8, len(x))
                if not size or v != decontaminate.EXACT and len(x) < 5 or size == 1 and len(y) != 1:
                    continue
                for a in range(len(x) - size + 1):
                    if sum(slot[a : a + size]) * 2 > size:
                        continue
                    for b in range(len(y) - size + 1):
                        if x[a : a + size] == y[b : b + size]:
                            pairs = {(int(theirs[v].value[a + k]), int(mine[v].value[b + k])) for k in range(size) if slot[a + k]}
                            hit |= len({p for p, _ in pairs}) == len({q for _, q in pairs}) == len(pairs)
            assert ((d, i) in got) == hit, (doc, item)
    for d in range(30, 50):
        assert got[d, d - 30] == 1.0 or len(items[d - 30].split()) == 1


def test_decontamination_keeps_columns_of_any_name(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = frame(spark, [(1, ITEM, "en", "s", 0), (2, "clean", "en", "s", 0), (None, ITEM, "en", "s", 0)]).withColumns({c: F.lit(0) for c in ("_bad", "bad", "rows", "item_ids", "windows", "coverage", "contaminated")})
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert decontaminate.decontamination(docs, items).where("contaminated").count() == 2


def test_decontamination_by_broadcast_and_by_shuffle_is_the_same(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    one, many = (sorted(map(str, decontaminate.matched_pairs(docs, items, n).collect())) for n in (10**6, 0))
    assert one == many
    verbatim = {d["doc_id"] for d in docs.collect() if any(i["text"] in (d["text"] or "") for i in items.collect())}
    found = {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()}
    assert verbatim <= found
    assert decontaminate.decontamination(docs, items.limit(0)).where("contaminated").count() == 0


# 7 Quality, 4 language, 6 language model


def test_factor_machine_identity_and_held_out_accuracy(spark, data):
    rng = np.random.default_rng(0)
    m = quality_fm.FactorMachine(0.3, rng.normal(size=quality_fm.BUCKETS + quality_fm.STATS), rng.normal(size=(quality_fm.BUCKETS + quality_fm.STATS, 3)), np.zeros(quality_fm.STATS), np.ones(quality_fm.STATS))
    b, x, stats = np.array([1, 5, 9]), np.array([0.5, 0.2, 0.1]), rng.normal(size=(1, quality_fm.STATS))
    at = np.concatenate([b, np.arange(quality_fm.BUCKETS, quality_fm.BUCKETS + quality_fm.STATS)])
    v = np.concatenate([x, stats[0]])
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * v[i] * v[j] for i, j in itertools.combinations(range(len(at)), 2))
    assert quality_fm._forward(m, b, x, np.zeros(3, int), stats)[0][0] == pytest.approx(0.3 + m.linear[at] @ v + pairs)
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality_fm.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got if not r["held_out"]]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in got if r["held_out"]]) > 0.85


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(902, 1, 0), (904, 0, 0), (None, 1, 0), (905, None, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = quality_fm.quality_scores(frame(spark, ODD, True), lab).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality_fm.quality_scores(frame(spark, []), labels).count() == 0


def test_language_id(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = lang_id.language_id(docs).join(docs, "doc_id").where("held_out").collect()
    assert got and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    odd = lang_id.language_id(frame(spark, [*ODD, (906, "12 34 !", "en", "s", 0)], True)).collect()
    assert len(odd) == len(ODD) + 1
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and not r["accepted"] for r in odd if r["doc_id"] in (901, 902, 903, 906))
    none = lang_id.language_id(frame(spark, [(1, "text", None, "s", 0)])).collect()
    assert none[0]["lang_pred"] == "und" and lang_id.language_id(frame(spark, [])).count() == 0


def test_language_prediction_is_row_by_row(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = lang_id.fit(docs)
    texts = pa.array([r["text"] for r in docs.limit(40).collect()])
    alone = np.concatenate([lang_id.logits(texts.slice(i, 1), model) for i in range(len(texts))])
    assert np.allclose(alone, lang_id.logits(texts, model))


def plain_subwords(text):
    """Buckets of the byte 2-, 3- and 4-grams, one at a time."""
    raw = "".join(c.lower() if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text).encode()
    raw = bytes(x if chr(x).isalnum() and x < 128 or x == 95 or x >= 128 else 32 for x in raw)
    out = []
    for at in range(len(raw)):
        for k in (2, 3, 4):
            if at + k <= len(raw):
                code = 0
                for i, x in enumerate(raw[at : at + k]):
                    code = (code * 0x01000193 + x) % 2**32 if i else x
                h = (code * 0x9E3779B1 + (k * 0x85EBCA6B & 0xFFFFFFFF)) % 2**32
                h ^= h >> 15
                out.append((h * 0x2C1B3C6D % 2**32) >> (32 - lang_id.BITS))
    return out


@pytest.mark.parametrize("piece", [5, 1 << 17])
def test_language_forward_pass_and_gradient_against_plain_loops(monkeypatch, piece):
    monkeypatch.setattr(lang_id, "PIECE", piece)
    rng = random.Random(41)
    texts = ["".join(rng.choice("aB c9_ÀéЖ\n.,") for _ in range(rng.randint(0, 40))) for _ in range(20)] + [None, "", "a", "ab"]
    want = [plain_subwords(t or "") for t in texts]
    got = lang_id.shares(pa.array(texts))
    for (b, c), w in zip(got, want):
        kinds, n = np.unique(np.array(w, int), return_counts=True)
        assert b.tolist() == kinds.tolist() and np.allclose(c, n / max(1, len(w)))
    r = np.random.default_rng(1)
    model = lang_id.LanguageModel(["x", "y"], np.vstack([r.normal(size=(lang_id.BUCKETS, 2)), np.zeros(2)]), r.normal(size=2))
    for z, w in zip(lang_id.logits(pa.array(texts), model), want):
        assert np.allclose(z, (np.mean([model.table[b] for b in w], axis=0) if w else 0) + model.bias)
    emb, soft, bias, y = r.normal(size=(lang_id.BUCKETS, 3)), r.normal(size=(3, 2)), r.normal(size=2), r.integers(0, 2, 6)
    part = [x for x in got if len(x[0])][:6]

    def loss():
        total = 0.0
        for (b, c), k in zip(part, y):
            z = sum(emb[i] * v for i, v in zip(b, c)) @ soft + bias
            total -= z[k] - np.log(np.exp(z).sum())
        return total / len(part)

    touched, ge, gs, gb = lang_id.gradients(part, y, emb, soft, bias)
    for table, grad, at in [(emb, ge[0], (touched[0],)), (emb, ge[-1], (touched[-1],)), (soft, gs[1], (1,)), (bias, gb, ())]:
        for f in range(len(grad)):
            old = table[(*at, f)]
            sides = []
            for step in (1e-5, -1e-5):
                table[(*at, f)] = old + step
                sides.append(loss())
            table[(*at, f)] = old
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(grad[f], abs=1e-6)


def test_quality_features_and_gradient_against_plain_loops():
    rng = random.Random(71)
    texts = ["".join(rng.choice("aB c9_Àé!#|\n.,  ab") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [None, "", "one one two"]
    (b, x, row, stats), *rest = quality_fm.features(pa.array(texts), pa.array([None] * len(texts), pa.int64()))
    assert not rest
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in t)
    for r, t in enumerate(texts):
        t = t or ""
        raw, w = t.encode(), re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", fold(t))
        share = lambda some: sum(c in some for c in raw) / max(1, len(raw))  # noqa: E731, B023
        pairs, n = list(zip(w, w[1:])), max(1, len(w))
        top = max([w.count(v) for v in w], default=0)
        want = [share(bytes(range(65, 91))), share(b"0123456789"), sum(33 <= c < 127 and not chr(c).isalnum() and c != 95 for c in raw) / max(1, len(raw)), share(b"#$%&*"), share(b"|{}<>"), share(b"!"), share(b".,"), share(b"\n")]
        want += [len(set(w)) / n, len(set(pairs)) / max(1, len(pairs)), top / n, sum(a == c for a, c in pairs) / n, sum(len(v.encode()) for v in w) / n, np.log1p(len(t))]
        assert np.allclose(stats[r], want), t
        assert (x[row == r] ** 2).sum() == pytest.approx(1 if w else 0) and len(set(b[row == r])) == (row == r).sum() <= len(set(w))
    d = quality_fm.BUCKETS + quality_fm.STATS
    g = np.random.default_rng(5)
    m = quality_fm.FactorMachine(0.1, g.normal(size=d), g.normal(0, 0.3, size=(d, 2)), np.zeros(quality_fm.STATS), np.ones(quality_fm.STATS))
    y = g.integers(0, 2, len(texts)).astype(float)

    def loss():
        p = quality_fm._logistic(quality_fm._forward(m, b, x, row, stats)[0])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    by_bias, by_linear, by_factors = quality_fm.gradients(m, b, x, row, stats, y)
    for table, grad, at in [(m.linear, by_linear, (b[0],)), (m.linear, by_linear, (quality_fm.BUCKETS + 3,)), (m.factors, by_factors, (b[0], 1)), (m.factors, by_factors, (quality_fm.BUCKETS + 8, 0))]:
        old, sides = table[at], []
        for step in (1e-5, -1e-5):
            table[at] = old + step
            sides.append(loss())
        table[at] = old
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(grad[at], abs=1e-6)
    p = quality_fm._logistic(quality_fm._forward(m, b, x, row, stats)[0])
    assert by_bias == pytest.approx((p - y).mean())


def test_quality_takes_missing_n_chars_from_the_text(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, ("äöü " if i % 2 else "x!x ") * (i + 1), "en", "s", 4 * (i + 1)) for i in range(40)]
    given = {r["doc_id"]: r["score"] for r in quality_fm.quality_scores(frame(spark, rows), labels).collect()}
    missing = {r["doc_id"]: r["score"] for r in quality_fm.quality_scores(frame(spark, [(*r[:4], None) for r in rows]), labels).collect()}
    assert given == pytest.approx(missing)


def halves(spark, texts):
    """The half of the target documents that each text would be in."""
    return {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", (F.pmod(F.xxhash64("t"), F.lit(2)) + 1).alias("h")).collect()}


def test_lm_score_tells_target_documents_that_it_has_not_seen(spark):
    rng = random.Random(62)
    kinds = [[words(rng, 1) for _ in range(60)] for _ in range(2)]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60)), "en", "s", 0) for i in range(120)]
    rows += [(200, rows[0][1], "en", "s", 0)]
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_score(frame(spark, rows), spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")).collect()}
    seen, new, others = ([got[i] for i in some] for some in (range(0, 60, 2), range(60, 120, 2), range(1, 120, 2)))
    assert max(seen + new) < min(others) and abs(np.mean(seen) - np.mean(new)) < 0.2 * abs(np.mean(others) - np.mean(new))
    assert got[200] == pytest.approx(got[0])


def test_lm_score_against_plain_counts(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 15) + " ÀB. x", "en", "s", 0) for i in range(30)] + ODD[:4]
    good = spark.createDataFrame([(i,) for i in range(10)] + [(None,), (5000,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_score.lm_score(frame(spark, rows, True), good).collect()}

    def tokens(t):
        buf, off = np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])
        return [int(x) for x in lm_score.tokens(buf, off)[0]]

    def count(texts):
        seen = {}
        for t in texts:
            b = tokens(t)
            for i, x in enumerate(b):
                for k in range(1, lm_score.ORDER + 1):
                    ctx = tuple(b[i - j] if i - j >= 0 else 32 for j in range(k - 1, 0, -1))
                    seen[k, ctx, x] = seen.get((k, ctx, x), 0) + 1
                    seen[k, ctx] = seen.get((k, ctx), 0) + 1
        return seen

    def loss(t, seen):
        b, total = tokens(t), 0.0
        for i, x in enumerate(b):
            p = 1 / 256
            for k in range(1, lm_score.ORDER + 1):
                ctx = tuple(b[i - j] if i - j >= 0 else 32 for j in range(k - 1, 0, -1))
                p = (seen.get((k, ctx, x), 0) + lm_score.SMOOTHING * p) / (seen.get((k, ctx), 0) + lm_score.SMOOTHING)
            total -= np.log(p)
        return total / len(b)

    half = halves(spark, [r[1] for r in rows])
    target = {h: count(r[1] for r in rows if r[0] is not None and r[0] < 10 and half[r[1]] == h) for h in (1, 2)}
    background = count(r[1] for r in rows)
    for r in rows[:30]:
        assert got[r[0]]["target_loss"] == pytest.approx(loss(r[1], target[3 - half[r[1]]]), abs=1e-4) and got[r[0]]["background_loss"] == pytest.approx(loss(r[1], background), abs=1e-4)
    assert got[901]["score"] is None and got[902]["n_tokens"] == 0 and got[903]["score"] is None
    assert lm_score.lm_score(frame(spark, []), good).count() == 0


@pytest.mark.parametrize("span", [1 << 14, 2])
def test_lm_counts_are_exact_whatever_the_number_of_ngrams(spark, monkeypatch, span):
    monkeypatch.setattr(lm_score, "SPAN", span)
    rng = random.Random(61)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789éßЖ"
    rows = [(i, "".join(rng.choice(letters) for _ in range(1500)), "en", "s", 0) for i in range(200)]
    rows += [(None, rows[0][1], "en", "s", 0), rows[3]]
    got = lm_score.lm_score(frame(spark, rows), spark.createDataFrame([(i,) for i in range(20)], "doc_id long"), 60_000)
    half = halves(spark, [r[1] for r in rows])
    models = {0: {}, 1: {}, 2: {}}
    for i, t, *_ in rows:
        b = b"    " + t.encode()
        for m in [models[0], *([models[half[t]]] if i is not None and i < 20 else [])]:
            for at in range(4, len(b)):
                for k in range(5):
                    for key in (b[at - k : at + 1], (b[at - k : at],)):
                        m[key] = m.get(key, 0) + 1

    def loss(t, m):
        b, total = b"    " + t.encode(), 0.0
        for at in range(4, len(b)):
            p = 1 / 256
            for k in range(5):
                p = (m.get(b[at - k : at + 1], 0) + 8 * p) / (m.get((b[at - k : at],), 0) + 8)
            total -= np.log(p)
        return total / (len(b) - 4)

    got = got.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] in (None, 3, 19, 20, 150):
            assert r["background_loss"] == pytest.approx(loss(texts[r["doc_id"]], models[0]), abs=1e-5)
            assert r["target_loss"] == pytest.approx(loss(texts[r["doc_id"]], models[3 - half[texts[r["doc_id"]]]]), abs=1e-5)


# 1 Licences


def test_license_scan(spark):
    mit = license_scan.KNOWN[0][1]
    other = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(", ", " ,  ").replace("SUBLICENSE", "SUB-LICENSE")
    rows = [(1, mit, "", "", 0), (2, other, "", "", 0), (3, mit + " Not really.", "", "", 0), (4, "text\nReleased under the MIT Licence!\nmore", "", "", 0), *ODD]
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, rows, True)).collect()}
    assert got[1]["license"] == got[2]["license"] == "MIT" and got[3]["license"] is None
    assert got[4]["license"] is None and got[4]["notices"] == ["MIT"]
    assert all(got[r[0]]["license"] is None and got[r[0]]["notices"] == [] for r in ODD)
    assert license_scan.license_scan(frame(spark, [])).count() == 0


def test_license_notices_that_wrap(spark):
    rows = [(1, "a\nThis work is licensed under the GNU\nGeneral Public Licence, version 3.\nb", "", "", 0), (2, "This work is\nlicensed under the GNU General Public License, version 3.", "", "", 0), (3, "// SPDX-License-Identifier: MPL-2.0\ncode", "", "", 0)]
    got = {r["doc_id"]: r["notices"] for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {1: ["GPL-3.0"], 2: [], 3: ["MPL-2.0"]}


def test_license_on_the_line_of_its_copyright(spark):
    mit = license_scan.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 A. Person. " + mit.replace("\n", " "), "", "", 0), (2, "a\n(c) 2019 B, all rights reserved. Licensed under the MIT License.\nb", "", "", 0), (3, "MIT License Copyright 2001 by C " + mit, "", "", 0), (4, "Copyright 2020 Permission", "", "", 0)]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got[1][0] == got[3][0] == "MIT" and got[2] == (None, ["MIT"]) and got[4] == (None, [])


def test_license_of_whole_texts(spark):
    """The texts that the system ships, where it does."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl"}
    texts, want = ["no licence"], [None]
    for file, name in names.items():
        path = f"/usr/share/common-licenses/{file}"
        if os.path.exists(path):
            body = open(path, encoding="utf-8").read()
            texts += [body, "Copyright (c) 2021 A. Person\n\n" + body.upper().replace("LICENSE", "LICENCE") + "\n\n", body + " But not here."]
            want += [name, name, None]
    got = license_scan.license_scan(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])).collect()
    assert [r["license"] for r in sorted(got, key=lambda r: r["doc_id"])] == want


# 2 URLs


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [r for r in url_filter.LIST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.rule), default=None)
    return host, path, best and best.rule, best and best.verdict


PAGES = "page_id long, url string, html string"


def test_url_rules_and_mining(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x=1#y", "https://example.com/en/8", "http://notexample.com/en/7", "ftp://x.net/de/8", "http://example.net/de/81", "a://b://c/d", "http://h?q=/p", "http://org/es/", "http://W.org/es/\nz", "http://É.com/en/"]
    rows = [(i, u, None) for i, u in enumerate(urls)]
    rows += [(100 + i, f"http://spam{i % 2}.biz/buy/{i}.php?ref=1", None) for i in range(40)] + [(200 + i, f"http://good{i % 7}.biz/read/{i}", None) for i in range(60)]
    pages = spark.createDataFrame([*rows, rows[5]], PAGES).withColumn("verdict", F.lit(0))
    labels = spark.createDataFrame([(r[0], r[0] < 200) for r in rows if 100 <= r[0] < 230] + [(200, None), (None, True)], "page_id long, block boolean")
    mined = url_filter.mine_rules(pages, labels)
    got = url_filter.judge(pages, mined).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        host, path, rule, verdict = brute_url(dict((a, b) for a, b, _ in rows)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if 100 <= r["page_id"] < 200 else "allow"))
    sets = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_filter.tokens_of(F.col("url")).alias("t")).collect()}
    known = {r["page_id"]: r["block"] for r in labels.collect() if r["page_id"] is not None and r["block"] is not None}
    holds = lambda needs, page: all(set(some) & sets[page] for some in needs)
    rules = mined.collect()
    assert rules
    for rule in rules:
        hit = [known[p] for p in known if holds(rule["tokens"], p)]
        assert rule["confidence"] == pytest.approx(sum(hit) / len(hit)) and len(hit) == rule["pages"] and sum(hit) >= url_filter.MIN_COUNT
    for r in got:
        fit = [m["confidence"] for m in rules if holds(m["tokens"], r["page_id"])]
        assert r["confidence"] == (max(fit) if fit else None)
    shuffled = url_filter.judge(pages, mined, most_broadcast=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))


def test_url_mining_finds_what_brute_force_finds(spark):
    """Every token set with a significant confidence is a rule, or holds a rule that is as sure."""
    rng = random.Random(81)
    rows, bad = [], {}
    for i in range(1500):
        host, part, key = f"h{rng.randrange(12)}.org", rng.choice("abcd"), rng.choice("xyz")
        rows.append((i, f"http://{host}/{part}?{key}=1", None))
        bad[i] = rng.random() < (0.9 if host == "h3.org" or (part == "b" and key == "y") else 0.15)
    pages = spark.createDataFrame(rows, PAGES)
    sets = {r["page_id"]: frozenset(r["t"]) for r in pages.select("page_id", url_filter.tokens_of(F.col("url")).alias("t")).collect()}
    mined = [(r["tokens"], r["confidence"]) for r in url_filter.mine_rules(pages, spark.createDataFrame(list(bad.items()), "page_id long, block boolean")).collect()]
    count, hits = {}, {}
    for i, t in sets.items():
        for k in range(1, 5):
            for some in itertools.combinations(sorted(t), k):
                count[some] = count.get(some, 0) + 1
                hits[some] = hits.get(some, 0) + bad[i]
    base = sum(bad.values()) / len(bad)
    fits = lambda needs, some: all(set(x) & set(some) for x in needs)
    part = lambda p, q: p * np.log(p / q) if p else 0.0
    found = 0
    for some, n in count.items():
        c = hits[some] / n
        sure = hits[some] >= 5 and c >= 0.5 and n * (part(c, base) + part(1 - c, 1 - base)) >= np.log(len(count) / 0.01)
        if sure:
            found += 1
            assert any(fits(needs, some) and conf >= c - 1e-9 for needs, conf in mined), some
    assert found and {i for i, t in sets.items() if any(fits(needs, t) for needs, _ in mined)} == {i for i, t in sets.items() if "h2:h3.org" in t or {"p1:b", "q:y"} <= t}


def test_url_labels_of_chance_give_no_rules(spark):
    rng = random.Random(82)
    rows = [(i, f"http://h{rng.randrange(30)}.org/{rng.choice('abcd')}?{rng.choice('xyz')}=1", None) for i in range(3000)]
    labels = spark.createDataFrame([(i, rng.random() < 0.25) for i in range(3000)], "page_id long, block boolean")
    pages = spark.createDataFrame(rows, PAGES)
    mined = url_filter.mine_rules(pages, labels)
    assert mined.count() == 0 and url_filter.judge(pages, mined, ()).where("verdict = 'block'").count() == 0


def test_url_tokens_that_are_not_mined_could_give_no_rule(spark, monkeypatch):
    """The cut before mining keeps every set that any confidence could make significant, and drops most rare tokens."""
    rng = random.Random(83)
    rows = [(i, f"http://site{rng.randrange(4)}.org/{rng.choice('abcd')}/{rng.choice('efgh') * rng.randrange(1, 60)}", None) for i in range(4000)]
    labels = [(i, rng.random() < (0.97 if "site1.org/a" in rows[i][1] else 0.2)) for i in range(4000)]
    base = sum(b for _, b in labels) / len(labels)
    for tokens in (1, 60, 5_000, 10**9):
        least = url_filter.least_hits(tokens, base)
        assert least == url_filter.MIN_COUNT or (least - 1) * -math.log(base) < math.log(tokens / url_filter.ALPHA) <= least * -math.log(base) + 1e-6
        for hits in range(1, least):  # the surest case is that all pages are blocked
            chance = [hits * math.log(hits / n / base) + ((n - hits) * math.log((1 - hits / n) / (1 - base)) if n > hits else 0) for n in range(hits, hits + 40) if hits / n > base]
            assert hits < url_filter.MIN_COUNT or max(chance) < math.log(tokens / url_filter.ALPHA)
    pages, known = spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, "page_id long, block boolean")
    rules = lambda: {(str(r["tokens"]), r["confidence"], r["pages"]) for r in url_filter.mine_rules(pages, known).collect()}
    got = rules()
    monkeypatch.setattr(url_filter, "least_hits", lambda *a: url_filter.MIN_COUNT)
    everything = rules()
    assert everything and everything <= got


def test_url_rules_see_the_whole_url(spark):
    shapes = ["http://a.b.{m}.c.site.org.uk/x/y", "http://site.uk/a/b/c/{m}/e", "http://site.uk/a?k=1&l=2&m=3&n=4&{m}=5", "http://site.uk" + "/a" * 12 + "/{m}?" + "&".join(f"k{i}=1" for i in range(25))]
    for shape in shapes:
        rows = [(i, shape.format(m="bad" if i < 40 else f"fine{'abcdefg'[i % 7]}"), None) for i in range(100)]
        pages = spark.createDataFrame(rows, PAGES)
        labels = spark.createDataFrame([(i, i < 40) for i in range(100) if i % 2], "page_id long, block boolean")
        got = url_filter.judge(pages, url_filter.mine_rules(pages, labels), ()).collect()
        assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(40)), shape


def test_url_filter_without_labels_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/es/x", None)], PAGES)
    mined = url_filter.mine_rules(pages, spark.createDataFrame([], "page_id long, block boolean"))
    assert mined.count() == 0 and url_filter.judge(pages, mined).first()["verdict"] == "block"
    assert url_filter.judge(pages.limit(0), mined).count() == 0


# 8 WARC


def test_warc_round_trip(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i % 5}</p>" * 20) for i in range(40)] + [(100, None, None), (101, "u\r\nx", ""), (102, "u", "x" * 700_000), (103, "ü", "ünïcode"), (103, "ü", "ünïcode"), (None, "u", "alone"), (None, "u", "<p>1</p>" * 20), (None, "u", "none"), (None, "v", "none")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("sha", F.lit(0)).repartition(4)
    for least in (0, 60):
        got = warc.round_trip(spark, pages, least).collect()
        assert len(got) == len(rows)
        best = {}
        for i, _, h in rows:
            best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
        want = []
        for i, _, h in rows:
            data = (h or "").encode()
            kind = "response" if len(data) < least or best[h or ""] == (-1 if i is None else i) else "revisit"
            want.append((i, len(data), warc.sha1_digest(data), kind, best[h or ""] if kind == "revisit" else None))
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_reader_refuses_what_breaks_the_format():
    good = [warc.record(i, "http://a", b"payload %d" % i, "response", None) for i in range(30)]
    out = io.BytesIO()
    assert warc.write_archive(out, iter(good)) == 30
    data = out.getvalue()
    assert list(warc.read_frames(io.BytesIO(data))) == good
    for broken in (b"", data[:6], b"\x00" + data[1:], data[:-3], data[:-20] + b"\x00" * 20):
        with pytest.raises(warc.WarcError):
            [warc.page_row(warc.parse_record(f)) for f in warc.read_frames(io.BytesIO(broken))]
    for raw in (good[0].replace(b"Content-Length: ", b"Content-Length: 9", 1), good[0][:-2], good[0].replace(b"WARC/1.1", b"WARC/9"), good[0].replace(b"payload 0", b"payload X"), good[0].replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.page_row(warc.parse_record(raw))
