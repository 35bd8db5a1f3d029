"""Benchmark decontamination by template canonicalisation.

Numbers become ``<num>``, capitalised words ``<name>``, units of measure
``<unit>``; other words stay, case folded.  A run of name words, or of number words, is one placeholder, so that values of
other lengths fit.  Windows of ``WIDTH`` template tokens are hash-joined
with those of the benchmark items, so a question with other numbers, names or units still
matches.  Matches on one alignment of a document and an item are then checked for slots: the same
value in the item must always meet the same value in the document, and different values different
ones.  Placeholders may fill at most half of a window.  Where they fill more, or an item is short, whole templates (of up to
``WHOLE`` tokens) are compared instead, if they hold two other words and two placeholders, or one and three: arithmetic is found with other
numbers.  Windows of the words and numbers themselves are compared too, whatever they are.  A sentence's first word may be a name or not, and case may be
lost, so a text has three templates: names inside sentences, at their starts too, and none at all.  Alignments whose shifts lie near each other (inserted or deleted
words) are united, the one with most windows first, and share one set of slots.  A document is contaminated by an item if their
consistent windows cover at least ``COVER`` of the item's words, or ``LONGEST`` of its words in a row.

Both sides are tables of windows, with their slots' values, made where the texts are read.  Of the documents' windows only those
leave a task that a bitmap of the items' window hashes lets pass (64 bits for each, at most ``MOST_BITS``; built by one aggregation),
so the join sees little more than the matches, whatever the documents' size, and the benchmark never passes through the driver.  The items'
windows are broadcast if they are counted to be at most ``MOST_BROADCAST``, else both sides are shuffled by hash.  Windows that
join are brought together by document and item, where slots and coverage are checked.

Items of one template whose values are equal at the same places, such as one exercise with thousands of numbers, would match alike, so the smallest
item_id stands for them; of the others only windows of words that hold values are compared, which find a copy of just that item.  So a document
and a template are one pair, however many items there are.

Defined cases: null, empty and wordless texts match nothing; an item of fewer than ``WIDTH`` tokens is
one window, compared with every run of that many tokens, as a template as said above; an item of
one word matches only the documents that are that word; null ids are
ignored on the item side, and on the document side a row is judged by its own text, whether its id is null or occurs again; repeated rows
are judged alike; an empty benchmark leaves every document clean; items of equal text are all reported.  A text of any length is read
whole, in one step.  Extra columns are ignored; ``keep_clean`` passes them through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspine.llm import textops
from larkspine.llm.shared import written

WIDTH = 8
SHORTEST = 5
#: Tokens of a template of placeholders mainly that is compared as a whole; a longer one in all its windows of so many.
WHOLE = 24
COVER = 0.5
#: So many words of an item in a row are a leak, whatever their share of the item.
LONGEST = 50
#: Shifts of an alignment's neighbours differ by so many words at most, or by half the item's.
NEAR = 16
#: Of the bitmap that documents' windows are held against: 64 MB.
MOST_BITS = 1 << 29
#: Windows of the items that are broadcast to the join; more are shuffled.
MOST_BROADCAST = 200_000
#: Units of measure.
UNITS = ("mm cm m km in ft yd mi mg g kg lb oz ml l ms s sec min h hr hour hours minute minutes second seconds day days week weeks year years month months "
         "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds "
         "liter liters litre litres dollar dollars cent cents euro euros percent degrees").split()  # fmt: skip
#: Number words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()

#: Views of a text, see templates().
VIEWS = 4
#: The view without placeholders.
EXACT = 1

NUM, NAME, UNIT = np.uint64(0xA11CE), np.uint64(0xB0B), np.uint64(0x5E771)


def _hashes(words: list[str]) -> np.ndarray:
    text = pa.array([" ".join(words)])
    _, _, buf, off = next(textops.steps(text))
    return np.sort(textops.words(buf, off).hash)


_UNIT_HASHES, _NUMBER_HASHES = _hashes(UNITS), _hashes(NUMBERS)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


@dataclass
class Template:
    """Tokens of one step: template hash, value hash, slot flag, row, first token of each row; the words start to stop-1 of the row."""

    token: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    row: np.ndarray
    first: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def templates(buf: np.ndarray, off: np.ndarray) -> list[Template]:
    """The views of a step's texts that are compared; items and documents are compared view by view."""
    w = textops.words(buf, off)
    n = len(w.hash)
    if not n:
        e = np.zeros(0, np.int64)
        return [Template(w.hash, w.hash, np.zeros(0, bool), w.row, w.first, e, e)] * VIEWS
    digit = np.concatenate([[0], np.cumsum((buf >= 0x30) & (buf <= 0x39))])
    digits = digit[w.end] - digit[w.start] == w.end - w.start
    number = digits | _among(w.hash, _NUMBER_HASHES)
    stop = np.concatenate([[0], np.cumsum((buf == 0x2E) | (buf == 0x21) | (buf == 0x3F) | (buf == 0x0A) | (buf == 0x3A))])
    before = np.empty(n, np.int64)
    before[1:], before[0] = w.end[:-1], 0
    opens = np.zeros(n, bool)
    opens[w.first[:-1][w.counts > 0]] = True
    begins = opens | (stop[w.start] - stop[np.minimum(before, w.start)] > 0)
    head = buf[w.start]
    second = buf[np.minimum(w.start + 1, len(buf) - 1)]
    third = buf[np.minimum(w.start + 1, w.end - 1)]
    upper = ((head >= 0x41) & (head <= 0x5A)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    shout = (third >= 0x41) & (third <= 0x5A) & (w.end - w.start > 1)
    unit = _among(w.hash, _UNIT_HASHES)
    after_number = np.zeros(n, bool)
    after_number[1:] = number[:-1] & (w.row[1:] == w.row[:-1])
    unit &= after_number
    joint = np.where(~opens & (w.start - before == 1), buf[np.minimum(before, len(buf) - 1)], 0)
    spaced = (joint == 0x20) | (joint == 0x0A) | (joint == 0x2D)
    point = (joint == 0x2E) | (joint == 0x2C)
    linked = number & after_number & (point | (spaced & ~digits))

    def view(name: np.ndarray) -> Template:
        name = name & ~number & ~unit
        follows = linked.copy()
        follows[1:] |= (name[1:] & name[:-1]) & (spaced | (joint == 0x27))[1:]
        at = np.flatnonzero(~follows)
        place = (np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))).astype(np.uint64)
        value = np.add.reduceat(np.where(follows, textops.mix(w.hash ^ (place * np.uint64(0xD1342543DE82EF95))), w.hash), at)
        token = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, w.hash)))[at]
        row = w.row[at]
        first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(off) - 1))])
        return Template(token, value, (number | unit | name)[at], row, first, at - w.first[row], np.append(at[1:], n) - w.first[row])

    place = np.arange(n) - w.first[w.row]
    exact = Template(w.hash, w.hash, np.zeros(n, bool), w.row, w.first, place, place + 1)
    return [view(upper & ~begins & ~shout), exact, view(upper & ~shout), view(np.zeros(n, bool))]


def _keys(t: Template, view: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, first token) of a view's windows of one size that are compared: those of the plain view, and those with slots,
    at most half of them; a window without slots is the plain view's."""
    h, row, at = textops.windows(t.token, t.first, size, short=False)
    if view != EXACT:
        slots = np.concatenate([[0], np.cumsum(t.slot)])
        n = slots[at + size] - slots[at]
        keep = (n > 0) & (n * 2 <= size)
        h, row, at = h[keep], row[keep], at[keep]
    return textops.mix(h ^ np.uint64(view * 64 + size), 51).view(np.int64), row, at


def _whole_keys(t: Template, view: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_keys() of the windows that _keys() leaves out for their placeholders or their size, if other words and placeholders suffice."""
    n = len(t.token)
    if n < size:
        e = np.zeros(0, np.int64)
        return e, e, e
    row = t.row
    at = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    k = slots[at + size] - slots[at]
    keep = ((k * 2 > size) | (size < SHORTEST)) & (((k >= 2) & (size - k >= 2)) | ((k >= 3) & (size - k >= 1)))
    at = at[keep]
    h = np.zeros(len(at), np.uint64)
    for i in range(size):
        h = textops.mix(h + t.token[at + i], 52)
    return textops.mix(h ^ np.uint64(view * 64 + size), 53).view(np.int64), row[at], at


def _classes(views: list[Template]) -> np.ndarray:
    """Of each row, what its templates without values are: tokens, their numbers of words, and at which places values are equal; 0 for a
    row without placeholders."""
    rows = len(views[EXACT].first) - 1
    out, any_slot = np.zeros(rows, np.uint64), np.zeros(rows, bool)
    for v, t in enumerate(views):
        if v == EXACT:
            continue
        for r in range(rows):
            a, z = t.first[r], t.first[r + 1]
            slot = t.slot[a:z]
            any_slot[r] |= slot.any()
            _, first, back = np.unique(t.value[a:z][slot], return_index=True, return_inverse=True)
            seen = np.zeros(z - a, np.uint64)
            seen[slot] = first[back].astype(np.uint64) + np.uint64(1)
            words = (t.stop[a:z] - t.start[a:z]).astype(np.uint64)
            own = textops.mix(t.token[a:z] ^ textops.mix(seen * np.uint64(131) + words, 54), 55)
            place = textops.mix(np.arange(1, z - a + 1, dtype=np.uint64), 56)
            out[r] = textops.mix(out[r : r + 1] + np.sum(own * place | np.uint64(1), dtype=np.uint64) + np.uint64(z - a), 57)[0]
    return np.where(any_slot, out, 0).astype(np.uint64).view(np.int64)


def _slots(t: Template, at: int, size: int) -> np.ndarray:
    return at + np.flatnonzero(t.slot[at : at + size])


_ITEM = "key long, item_id long, words int, view int, size int, at int, start int, stop int, slots binary, mine binary, kind long, valued boolean"
_ITEM_TYPES = (pa.int64(), pa.int64(), *(pa.int32(),) * 6, pa.binary(), pa.binary(), pa.int64(), pa.bool_())


def _item_windows(batches):
    """_ITEM of batches (item_id, text)."""
    for batch in batches:
        for lo, hi, buf, off in textops.steps(batch.column(1)):
            views = templates(buf, off)
            ids = batch.column(0).slice(lo, hi - lo).to_numpy()
            words = np.diff(views[EXACT].first)
            out = []
            kind = _classes(views)
            valued = np.zeros(len(views[EXACT].token) + 1, np.int64)  # words that are placeholders in the first view, added up
            for p in np.flatnonzero(views[0].slot):
                at = views[EXACT].first[views[0].row[p]]
                valued[1:][at + views[0].start[p] : at + views[0].stop[p]] = 1
            valued = np.cumsum(valued)
            for v, t in enumerate(views):
                n = np.diff(t.first)
                for keys, code, widest, least in ((_keys, v, WIDTH, 1 if v == EXACT else SHORTEST), (_whole_keys, v + VIEWS, WHOLE, 3)):
                    for size in range(least, widest + 1) if v != EXACT or code == v else ():
                        key, row, at = keys(t, v, size)
                        whole = n[row] >= widest if size == widest else n[row] == size
                        for k, r, p in zip(key[whole].tolist(), row[whole].tolist(), at[whole].tolist()):
                            s, w = _slots(t, p, size), int(views[EXACT].first[r])
                            start, stop = int(t.start[p]), int(t.stop[p + size - 1])
                            out.append((k, int(ids[r]), int(words[r]), code, size, p - int(t.first[r]), start, stop, t.start[s].astype(np.int32).tobytes(), t.value[s].tobytes(), int(kind[r]), bool(valued[w + stop] > valued[w + start])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), _ITEM_TYPES)], [c.split()[0] for c in _ITEM.split(", ")])


_DOC = "doc_id long, text_hash long, key long, pos int, begins int, other binary"
_DOC_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _doc_windows(batches, kinds: list[tuple[int, int]], bits: np.ndarray):
    """_DOC of batches (doc_id, text, text_hash): windows of the kinds (view, size) that the bitmap lets pass."""
    for batch in batches:
        for lo, hi, buf, off in textops.steps(batch.column(1)):
            views = templates(buf, off)
            out = []
            for v, size in kinds:
                t = views[v % VIEWS]
                key, row, at = (_keys if v < VIEWS else _whole_keys)(t, v % VIEWS, size)
                place = key.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
                near = np.flatnonzero(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
                if size == 1:
                    near = near[np.diff(t.first)[row[near]] == 1]
                for i in near.tolist():
                    r, p = int(row[i]), int(at[i])
                    out.append((lo + r, int(key[i]), p - int(t.first[r]), int(t.start[p]), t.value[_slots(t, p, size)].tobytes()))
            if out:
                rows, *rest = zip(*out)
                of = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), *(pa.array(c, ty) for c, ty in zip(rest, _DOC_TYPES[2:]))], [c.split()[0] for c in _DOC.split(", ")])


@dataclass(frozen=True, order=True)
class Hit:
    """A window that a document and an item share: its view and place in both, its words in the item, and its slots' values."""

    view: int
    shift: int
    at: int
    start: int
    stop: int
    begins: int
    slots: tuple[int, ...]
    mine: tuple[int, ...]
    other: tuple[int, ...]


def united(hits: set[Hit], words: int) -> tuple[int, float, int, int] | None:
    """(consistent windows, share of the item's words covered, slots with other values, most covered words in a row) of the best
    group of near alignments."""
    lines: dict[tuple[int, int], list[Hit]] = {}
    for hit in sorted(hits):
        lines.setdefault((hit.view, hit.shift), []).append(hit)
    groups: list[list] = []
    for offset, line in sorted(((line[0].begins - line[0].start, line) for line in lines.values()), key=lambda x: x[0]):
        if groups and offset - groups[-1][-1][0] <= max(NEAR, words // 2):
            groups[-1].append((offset, line))
        else:
            groups.append([(offset, line)])
    best = None
    for group in groups:
        there, here, kept, changed = {}, {}, set(), set()
        covered = np.zeros(words + 2, bool)
        for _, line in sorted(group, key=lambda x: (-len(x[1]), x[0])):
            for hit in line:
                fits, to, back = True, {}, {}
                for mine, other in zip(hit.mine, hit.other):
                    if there.get(mine, to.get(mine, other)) != other or here.get(other, back.get(other, mine)) != mine:
                        fits = False
                        break
                    to[mine], back[other] = other, mine
                if fits:
                    kept.add((hit.start, hit.begins))
                    covered[hit.start + 1 : hit.stop + 1] = True
                    there.update(to)
                    here.update(back)
                    changed.update(p for p, mine, other in zip(hit.slots, hit.mine, hit.other) if mine != other)
        if kept:
            turns = np.flatnonzero(covered[1:] != covered[:-1])
            score = (float(covered.sum()) / words, int((turns[1::2] - turns[::2]).max()), len(kept), len(changed))
            best = score if best is None else max(best, score)
    return best and (best[2], best[0], best[3], best[1])


_PAIR = "doc_id long, text_hash long, item_id long, windows long, coverage double, changed_slots long, longest long"
_PAIR_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())


def _checked(batches):
    """_PAIR of joined windows that come sorted by document and item."""
    now, hits, words, out = None, set(), 0, []

    def end():
        if now is not None and (best := united(hits, words)):
            out.append((*now, *best))

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for *key, n, view, at, pos, start, stop, begins, slots, mine, other in zip(*cols):
            if key != now:
                end()
                now, hits, words = key, set(), n
            hits.add(Hit(view, pos - at, at, start, stop, begins, tuple(np.frombuffer(slots, np.int32).tolist()), tuple(np.frombuffer(mine, np.uint64).tolist()), tuple(np.frombuffer(other, np.uint64).tolist())))
        if len(out) >= 1000:
            yield _pairs(out)
            out.clear()
    end()
    if out:
        yield _pairs(out)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), _PAIR_TYPES)], [c.split()[0] for c in _PAIR.split(", ")])


def matched_pairs(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, text_hash, item_id, windows, coverage, changed_slots, longest for every document and item with a consistent window; an item
    stands for those of equal text and, as the module says, for those of its template."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    made = written(spark, items.groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text").mapInArrow(_item_windows, _ITEM), "item-windows")
    first = made.where("kind <> 0").groupBy("kind").agg(F.min("item_id").alias("first"))
    kept = made.join(first, "kind", "left").where((F.col("kind") == 0) | (F.col("item_id") == F.col("first")) | ((F.col("view") == EXACT) & F.col("valued")))
    items = written(spark, kept.drop("kind", "first", "valued"), "benchmark-windows")
    n = items.count()
    if not n:
        return spark.createDataFrame([], _PAIR)
    kinds = sorted(map(tuple, items.select("view", "size").distinct().collect()))
    room = 1 << max(6, min(MOST_BITS.bit_length() - 1, (64 * n - 1).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(room - 1))
    found = items.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(room // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(bits)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    windows = texts.mapInArrow(lambda batches: _doc_windows(batches, kinds, held.value), _DOC)
    both = windows.join(F.broadcast(items) if n <= most_broadcast else items, "key")
    both = both.select("doc_id", "text_hash", "item_id", "words", "view", "at", "pos", "start", "stop", "begins", "slots", "mine", "other")
    both = both.repartition("doc_id", "text_hash", "item_id").sortWithinPartitions("doc_id", "text_hash", "item_id")
    return both.mapInArrow(_checked, _PAIR)


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, text_hash, item_ids, windows, coverage, changed_slots of the documents that an item contaminates."""
    pairs = matched_pairs(docs, benchmark).where((F.col("coverage") >= cover) | (F.col("longest") >= LONGEST))
    texts = benchmark.where("item_id is not null and text is not null").groupBy(F.col("text").cast("string").alias("text")).agg(F.collect_set(F.col("item_id").cast("long")).alias("ids"))
    equal = texts.where(F.size("ids") > 1).select(F.array_min("ids").alias("item_id"), "ids")
    pairs = pairs.join(equal, "item_id", "left").withColumn("item_id", F.explode(F.coalesce("ids", F.array("item_id"))))
    return pairs.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.sum("windows").alias("windows"), F.max("coverage").alias("coverage"), F.max("changed_slots").alias("changed_slots")
    )


def decontamination(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, contaminated, item_ids, windows, coverage, changed_slots for every document."""
    bad = contaminated(docs, benchmark, cover).withColumnsRenamed({"doc_id": "of", "text_hash": "hash_of"})
    rows = docs.select("doc_id", text_hash().alias("text_hash"))
    rows = rows.join(bad, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash_of")), "left")
    value = lambda c, none: F.coalesce(F.col(c), none).alias(c)
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), value("item_ids", F.array().cast("array<bigint>")), value("windows", F.lit(0)), value("coverage", F.lit(0.0)), value("changed_slots", F.lit(0)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all columns."""
    bad = contaminated(docs, benchmark, cover).select("doc_id", "text_hash").alias("bad")
    here = F.xxhash64(F.col("rows.text").cast("string"))
    return docs.alias("rows").join(bad, F.col("rows.doc_id").eqNullSafe(F.col("bad.doc_id")) & (here == F.col("bad.text_hash")), "left_anti")
