"""Chunkers: one text to many.  Slices, sentence windows and semantic merging are expressions; the fixed packer
is a fold; chunkers that recurse or work on offsets are functions that run over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspine.functions.text import jtrim, let

SIZE, OVERLAP = 1000, 200
#: Separators by priority, and those for code.
SEPARATORS = ["\n\n", "\n", "。", "，", ".", ",", " ", ""]
CODE_SEPARATORS = ["\nclass ", "\npublic class ", "\ninterface ", "\npublic interface ", "\nenum ", "\npublic enum ", "\n\n", "\n", " ", ""]
CODE_EXTENSIONS = ("java", "py", "js", "ts", "go", "rs", "cpp", "c", "h", "hpp")
BEFORE, CENTER, AFTER = ("[BEFORE]", "[BEFORE_END]"), ("[CENTER]", "[CENTER_END]"), ("[AFTER]", "[AFTER_END]")
SENTENCE = r"[^。！？.!?\n]+[。！？.!?]?"


def check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")


# Expressions


def slices(c: Column, size: int = SIZE, overlap: int = OVERLAP, stop_early: bool = True) -> Column:
    """Slices of ``size`` every ``size - overlap`` characters; without ``stop_early`` also those that only repeat the end."""
    check(size, overlap)
    step = size - overlap
    n = F.length(c)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)) if stop_early else F.greatest(F.ceil(n / step) - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(c, i * step + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def fixed(c: Column, size: int = SIZE, overlap: int = OVERLAP, separator: str = "\n\n") -> Column:
    """Pieces between separators, packed up to ``size``; a new chunk opens with pieces from the last one's end until
    they reach ``overlap`` (at least one).  An overlong piece is sliced.  The separator is literal."""
    check(size, overlap)
    sep = len(separator)
    pieces = F.filter(F.transform(F.split(c, "\\Q" + separator + "\\E"), jtrim), lambda p: p != "")
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("done"), empty.alias("held"), F.lit(0).alias("n"))

    def seed(held: Column) -> Column:
        back = F.aggregate(
            F.reverse(held),
            F.struct(empty.alias("kept"), F.lit(0).alias("n")),
            lambda a, p: F.when((F.size(a["kept"]) > 0) & (a["n"] >= overlap), a).otherwise(F.struct(F.concat(F.array(p), a["kept"]).alias("kept"), (a["n"] + F.length(p) + sep).cast("int").alias("n"))),
        )
        return back if overlap else F.struct(empty.alias("kept"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        flushed = F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(F.array_join(a["held"], separator)))).otherwise(a["done"])
        long = F.struct(F.concat(flushed, slices(p, size, overlap)).alias("done"), empty.alias("held"), F.lit(0).alias("n"))
        kept = seed(a["held"])
        full = F.struct(flushed.alias("done"), F.concat(kept["kept"], F.array(p)).alias("held"), (kept["n"] + F.length(p) + sep).cast("int").alias("n"))
        more = F.struct(a["done"].alias("done"), F.concat(a["held"], F.array(p)).alias("held"), (a["n"] + F.length(p) + sep).cast("int").alias("n"))
        return F.when(F.length(p) > size, long).when((a["n"] + F.length(p) + sep > size) & (F.size(a["held"]) > 0), full).otherwise(more)

    return F.aggregate(pieces, state, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(F.array_join(a["held"], separator)))).otherwise(a["done"]))


def sentences(c: Column) -> Column:
    """Trimmed sentences; where no sentence is found, the lines that aren't blank."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), jtrim), lambda s: s != "")
    lines = F.filter(F.transform(F.split(c, "\n"), jtrim), lambda s: s != "")
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(lines))


def sentence_windows(c: Column, width: int = 3) -> Column:
    """Each sentence with its neighbours, as tagged text."""
    tag = lambda mark, text: F.concat(F.lit(mark[0]), text, F.lit(mark[1]))

    def one(s: Column, x: Column, i: Column) -> Column:
        before = F.slice(s, F.greatest(i - width, F.lit(0)) + 1, F.least(i, F.lit(width)))
        after = F.slice(s, i + 2, F.lit(width))
        return F.concat(F.when(F.size(before) > 0, tag(BEFORE, F.array_join(before, ""))).otherwise(""), tag(CENTER, x), F.when(F.size(after) > 0, tag(AFTER, F.array_join(after, ""))).otherwise(""))

    return let(sentences(c), lambda s: F.transform(s, lambda x, i: one(s, x, i)))


def _between(c: Column, mark: tuple[str, str]) -> Column:
    start, end = F.instr(c, mark[0]), F.instr(c, mark[1])
    from_ = start + len(mark[0])
    return F.when((start > 0) & (end > start), F.substring(c, from_, F.greatest(end - from_, F.lit(0)))).otherwise("")


def center_sentence(c: Column) -> Column:
    return _between(c, CENTER)


def full_window(c: Column) -> Column:
    return F.concat(_between(c, BEFORE), _between(c, CENTER), _between(c, AFTER))


def unwrap(c: Column) -> Column:
    """A tagged chunk's full window; other text as it is."""
    return F.when(c.contains(CENTER[0]) & c.contains(CENTER[1]), full_window(c)).otherwise(c)


def semantic_sentences(c: Column) -> Column:
    """Sentences that end at a mark or line end once more than 10 characters have come together."""
    found = F.regexp_extract_all(c, F.lit(r"(?s).{10,}?[。？！\n.?!]|.+"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


# Semantic chunking over a table (doc_id, pos, sentence, embedding)


def context_windows(rows: DataFrame, buffer: int = 1) -> DataFrame:
    """Each sentence joined with ``buffer`` neighbours on both sides: what is embedded."""
    if buffer < 0:
        raise ValueError("buffer must not be negative")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-buffer, buffer)
    return rows.withColumn("context", F.array_join(F.collect_list("sentence").over(w), " "))


def distances(rows: DataFrame) -> DataFrame:
    """distance = 1 - cosine to the next sentence; null at the end of a document."""
    from larkspine.functions.vector import cosine

    w = Window.partitionBy("doc_id").orderBy("pos")
    return rows.withColumn("next", F.lead("embedding").over(w)).withColumn("distance", F.when(F.col("next").isNotNull(), 1 - cosine(F.col("embedding"), F.col("next")))).drop("next")


def threshold(kind: str, amount: float, value: str = "distance") -> Column:
    """Aggregate of a document's distances: PERCENTILE (nearest rank), STANDARD_DEVIATION or INTERQUARTILE."""
    v = F.col(value)
    if kind == "PERCENTILE":
        return F.expr(f"percentile_disc({amount / 100}) WITHIN GROUP (ORDER BY {value})")
    if kind == "STANDARD_DEVIATION":
        return F.avg(v) + amount * F.stddev_pop(v)
    if kind == "INTERQUARTILE":
        s = F.array_sort(F.collect_list(v))
        n = F.size(s)
        q1, q3 = F.try_element_at(s, F.floor(n / 4).cast("int") + 1), F.try_element_at(s, F.floor(3 * n / 4).cast("int") + 1)
        return q3 + amount * (q3 - q1)
    raise ValueError(kind)


def merge_at_breaks(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """doc_id, chunk_index, chunk: sentences joined, cut after those whose distance exceeds the document's threshold."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce((F.col("distance") > F.col("threshold")).cast("int"), F.lit(0))
    grouped = rows.join(limits, "doc_id", "left").withColumn("chunk_index", F.coalesce(F.sum(cut).over(w), F.lit(0)))
    return grouped.groupBy("doc_id", "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), "").alias("chunk"))


# Functions


def _cut(text: str, size: int, overlap: int, stop_early: bool = True) -> list[str]:
    out = []
    for at in range(0, len(text), size - overlap):
        out.append(text[at : at + size])
        if stop_early and at + size >= len(text):
            break
    return out


def recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] | None = None, level: int = 0) -> list[str]:
    """Splits at the first separator, packs what fits and goes on with the next separator for what doesn't."""
    check(size, overlap)
    marks = SEPARATORS if separators is None else separators
    if not text or not text.strip():
        return []
    if len(text) <= size:
        return [text]
    if level >= len(marks) or not marks[level]:
        return _cut(text, size, overlap)
    mark = marks[level]
    done: list[str] = []
    held: list[str] = []

    def width(parts: list[str]) -> int:
        return sum(map(len, parts)) + len(mark) * max(0, len(parts) - 1)

    for piece in text.split(mark):
        if not piece:
            continue
        if len(piece) > size:
            if held:
                done.append(mark.join(held))
            held = []
            done += recursive(piece, size, overlap, marks, level + 1)
            continue
        if held and width([*held, piece]) > size:
            done.append(mark.join(held))
            tail: list[str] = []
            for p in reversed(held):
                if not overlap or sum(map(len, tail)) >= overlap:
                    break
                tail.insert(0, p)
            held = tail
        held.append(piece)
    if held:
        done.append(mark.join(held))
    return done


@dataclass
class _Section:
    heading: str
    level: int
    body: str


_SPECIAL = (re.compile(r"```.*?```", re.S), re.compile(r"(?:^\|.*\|[ \t]*(?:\n|$))+", re.M))
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", re.M)


def markdown_mask(text: str) -> tuple[str, list[str]]:
    """Fenced code and tables become numbered placeholders."""
    spans: list[tuple[int, int]] = []
    for pattern in _SPECIAL:
        for m in pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b in spans):
                spans.append(m.span())
    out, kept, at = [], [], 0
    for a, b in sorted(spans):
        out += [text[at:a], f"\x00{len(kept)}\x00"]
        kept.append(text[a:b])
        at = b
    return "".join([*out, text[at:]]), kept


def markdown(text: str, size: int = SIZE, overlap: int = OVERLAP, parity: bool = False) -> list[str]:
    """Sections by heading, merged up to ``size``; overlong ones by paragraph.  With ``parity`` the first section is
    never split, slices repeat the end and an overlapping chunk repeats its heading."""
    check(size, overlap)
    if not text or not text.strip():
        return []
    masked, kept = markdown_mask(text)
    unmask = lambda s: re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], s)
    heads = list(_HEADING.finditer(masked))
    sections = [_Section("", 0, masked[: heads[0].start()] if heads else masked)]
    for m, after in zip(heads, [*heads[1:], None]):
        sections.append(_Section(m[2], len(m[1]), masked[m.end() : after.start() if after else len(masked)]))
    sections = [_Section(s.heading, s.level, unmask(s.body).strip()) for s in sections if s.body.strip()]
    full = lambda s: ("#" * s.level + " " + s.heading + "\n\n" if s.level else "") + s.body
    out, held, level = [], "", 0
    for s in sections:
        piece = full(s)
        if not held and (parity or len(piece) <= size):
            held, level = piece, s.level
        elif len(piece) > size:
            if held:
                out.append(held)
            held = ""
            out += _paragraphs(piece, size, overlap, parity)
        elif len(held) + len(piece) > 0.8 * size or (s.level <= level and s.level <= 2):
            out.append(held)
            held, level = (s.heading + "\n" + piece if parity and overlap and s.heading else piece), s.level
        else:
            held += "\n\n" + piece
    return [*out, held] if held else out


def _paragraphs(text: str, size: int, overlap: int, parity: bool) -> list[str]:
    out, held = [], ""
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if len(p) > size:
            if held:
                out.append(held)
            held = ""
            out += _cut(p, size, overlap, stop_early=not parity)
        elif held and len(held) + 2 + len(p) > size:
            out.append(held)
            held = p
        else:
            held = held + "\n\n" + p if held else p
    return [*out, held] if held else out


def parent_slices(text: str, size: int, overlap: int) -> list[str]:
    """Slices that end at the last full stop or line end inside them; the last one ends at the text's end."""
    check(size, overlap)
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            mark = max(text.rfind("。", at, end + 1), text.rfind("\n", at, end + 1))
            if mark > at + overlap:
                end = mark + 1
        out.append(text[at:end])
        if end >= len(text):
            break
        at = end - overlap
    return out


#: Texts that a function's task holds as Python strings at once.
BATCH = 100


def chunked(docs: DataFrame, function: Callable[[str], list[str]], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk by a function over whole texts."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):  # a batch's texts become Python strings a few at a time
                some = batch.slice(at, BATCH)
                out = [(d, i, c) for d, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()) for i, c in enumerate(function(t or ""))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.string()))], ["doc_id", "chunk_index", "chunk"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, chunk_index int, chunk string")


def exploded(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """doc_id, chunk_index, chunk by an expression."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("chunk_index", "chunk"))


def strategy(name: str, size: int = SIZE, overlap: int = OVERLAP, window: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A chunker over documents by name; unknown names mean the recursive one."""
    check(size, overlap)
    name = name.lower()
    if name in ("fixed", "fixed-size"):
        return lambda d: exploded(d, fixed(F.col("text"), size, overlap))
    if name in ("sentence-window", "sentence"):
        return lambda d: exploded(d, sentence_windows(F.col("text"), window))
    if name in ("markdown", "md"):
        return lambda d: chunked(d, _Bound(markdown, size, overlap))
    if name in ("code", "programming"):
        return lambda d: chunked(d, _Bound(recursive, size, overlap, CODE_SEPARATORS))
    if name == "semantic":
        return lambda d: exploded(d, semantic_sentences(F.col("text")))
    return lambda d: chunked(d, _Bound(recursive, size, overlap))


def strategy_for_file(name: str, default: str = "recursive") -> str:
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return "markdown" if ext in ("md", "markdown") else "code" if ext in CODE_EXTENSIONS else default


@dataclass
class _Bound:
    """A chunker with its parameters, which workers can unpickle."""

    function: Callable
    size: int
    overlap: int
    separators: list[str] | None = None

    def __call__(self, text: str) -> list[str]:
        return self.function(text, self.size, self.overlap, self.separators) if self.separators else self.function(text, self.size, self.overlap)
