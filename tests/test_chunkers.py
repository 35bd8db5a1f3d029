import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspine.operators import chunkers as c


def run(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_slices_rebuild_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1234))
    got = run(spark, lambda t: c.slices(t, 100, 30), text)
    assert got[0] + "".join(s[30:] for s in got[1:]) == text and all(len(s) <= 100 for s in got)
    assert run(spark, lambda t: c.slices(t, 100, 30), "") == [] and run(spark, lambda t: c.slices(t, 10, 0), "0123456789") == ["0123456789"]
    assert run(spark, lambda t: c.slices(t, 4, 2, stop_early=False), "abcdef") == ["abcd", "cdef", "ef"]


def test_fixed_packs_pieces_and_seeds_overlap(spark):
    text = "aaaa\n\nbbbb\n\n\n\ncccc\n\n" + "x" * 25 + "\n\ndd"
    assert run(spark, lambda t: c.fixed(t, 14, 0), text) == ["aaaa\n\nbbbb", "cccc", "x" * 14, "x" * 11, "dd"]
    assert run(spark, lambda t: c.fixed(t, 14, 2), "aaaa\n\nbbbb\n\ncccc") == ["aaaa\n\nbbbb", "bbbb\n\ncccc"]
    assert run(spark, lambda t: c.fixed(t, 10, 0, "."), "a.b") == ["a.b"]
    assert run(spark, lambda t: c.fixed(t, 10, 0), " \n\n ") == []


def test_recursive():
    assert c.recursive("short", 10, 2) == ["short"] and c.recursive("  ", 10, 2) == []
    assert c.recursive("aaa bbb ccc ddd", 7, 0, [" ", ""]) == ["aaa bbb", "ccc ddd"]
    assert c.recursive("aaa bbb ccc", 7, 3, [" ", ""]) == ["aaa bbb", "bbb ccc"]
    assert c.recursive("x" * 10, 4, 1, [" ", ""]) == ["xxxx", "xxxx", "xxxx"]
    assert c.recursive("一二三。四五六。七", 5, 0) == ["一二三", "四五六。七"]
    code = "import a\nclass A:\n  pass\nclass B:\n  pass"
    assert len(c.recursive(code, 20, 0, c.CODE_SEPARATORS)) == 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ,.\n。", max_size=200), st.integers(1, 30), st.integers(0, 10))
def test_recursive_keeps_to_the_size(text, size, overlap):
    overlap = min(overlap, size - 1)
    assert all(len(x) <= size + overlap for x in c.recursive(text, size, 0)) and "".join(c.recursive(text, size, 0)).count("a") == text.count("a")
    c.recursive(text, size, overlap)


def test_sentences_and_windows(spark):
    text = "One. Two!  \nThree? 四。"
    assert run(spark, c.sentences, text) == ["One.", "Two!", "Three?", "四。"]
    w = run(spark, lambda t: c.sentence_windows(t, 1), text)
    assert w[0] == "[CENTER]One.[CENTER_END][AFTER]Two![AFTER_END]"
    assert w[1] == "[BEFORE]One.[BEFORE_END][CENTER]Two![CENTER_END][AFTER]Three?[AFTER_END]"
    assert run(spark, c.full_window, w[1]) == "One.Two!Three?" and run(spark, c.center_sentence, w[1]) == "Two!"
    assert run(spark, c.unwrap, "plain [CENTER] text") == "plain [CENTER] text"
    assert run(spark, c.sentences, "...") == ["..."]


def test_semantic_thresholds_and_merge(spark):
    d = spark.createDataFrame([(1, i, f"s{i}.", x) for i, x in enumerate([0.1, 0.9, 0.2, 0.3, None])], "doc_id long, pos long, sentence string, distance double")
    at = lambda kind, n: d.where("distance is not null").groupBy("doc_id").agg(c.threshold(kind, n).alias("threshold"))
    assert at("PERCENTILE", 75).first()[1] == 0.3 and at("INTERQUARTILE", 1.0).first()[1] == pytest.approx(0.9 + 0.7)
    assert at("STANDARD_DEVIATION", 1).first()[1] == pytest.approx(0.375 + 0.3112475)
    assert [r["chunk"] for r in c.merge_at_breaks(d, at("PERCENTILE", 75)).orderBy("chunk_index").collect()] == ["s0.s1.", "s2.s3.s4."]
    with pytest.raises(ValueError):
        c.context_windows(d, -1)


MD = "intro text\n\n# One\n\nbody one\n\n```\n# not a heading\n```\n\n## Two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n# Three\n\n" + "long paragraph. " * 20 + "\n\nlast"


def test_markdown():
    got = c.markdown(MD, 120, 20)
    assert got[0].startswith("intro text") and any("# not a heading" in x for x in got) and any("| 1 | 2 |" in x for x in got)
    assert sum("# One" in x for x in got) == 1 and all(len(x) <= 120 for x in got)
    assert any("# Three" in x for x in got) and got[-1].endswith("last")
    assert c.markdown("", 10, 1) == [] and c.markdown("plain", 10, 1) == ["plain"]
    assert len(c.markdown("x" * 50, 20, 5, parity=True)) == 1 and len(c.markdown("x" * 50, 20, 5)) > 1


def test_parent_slices_end():
    text = "一二三。四五六七八。九十" * 5
    got = c.parent_slices(text, 12, 3)
    assert got[-1] == text[-len(got[-1]) :] and all(len(x) <= 12 for x in got) and got[0].endswith("。")
    with pytest.raises(ValueError):
        c.parent_slices(text, 5, 5)


def test_strategies(spark):
    docs = spark.createDataFrame([(1, MD), (2, None), (3, "")], "doc_id long, text string")
    for name in ("fixed", "recursive", "semantic", "code", "sentence-window", "markdown", "anything"):
        rows = c.strategy(name, 120, 20)(docs).collect()
        assert rows and {r["doc_id"] for r in rows} == {1} and sorted(r["chunk_index"] for r in rows) == list(range(len(rows)))
    assert [c.strategy_for_file(n) for n in ("a.MD", "b.py", "c", "d.txt")] == ["markdown", "code", "recursive", "recursive"]
    with pytest.raises(ValueError):
        c.strategy("fixed", 10, 10)


def plain_semantic(text):
    out, held = [], ""
    for ch in text:
        held += ch
        if ch in "。？！\n.?!" and len(held) > 10:
            out.append(held.strip())
            held = ""
    return [s for s in (*out, held.strip()) if s]


def test_semantic_sentences_against_a_plain_loop(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab c.?\n。é") for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", "Hi. there is more. ok", "no mark at all", "x" * 3000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", c.semantic_sentences(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: plain_semantic(t) for i, t in enumerate(texts)}


def test_a_batch_becomes_strings_a_few_at_a_time(spark):
    """However many rows a batch has, a task holds few of its texts as Python strings."""
    import tracemalloc

    import pyarrow as pa

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([str(i) * 2000 for i in range(4000)])], ["doc_id", "text"])
    run = c.chunked(Docs(), lambda t: [t[:10], t[10:20]])
    tracemalloc.start()
    rows = [(d, i, x) for out in run([batch]) for d, i, x in zip(*(y.to_pylist() for y in out.columns))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [(d, i, (str(d) * 2000)[10 * i : 10 * i + 10]) for d in range(4000) for i in range(2)]
    assert peak < 10e6 < batch.nbytes
