"""Vectorised text routines over Arrow string buffers.

Words are maximal runs of ASCII letters, digits, underscore and non-ASCII characters,
compared after folding case over ASCII and Latin-1.  All hashes are 64 bit and depend on
nothing but the bytes, so every executor and every run computes the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x5F, 0x60), (0x80, 0x100)):
        word[lo:hi] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    return word, lower


WORD_BYTE, LOWER_BYTE = _tables()
_POWERS = {0: np.ones(1, _U), 1: np.ones(1, _U)}
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, grown by doubling and kept up to two steps' bytes."""
    out = []
    for side, base in ((0, _BASE), (1, _INVERSE)):
        have = _POWERS[side]
        while len(have) < n:
            step = _U(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        if len(have) <= 2 * STEP_BYTES:
            _POWERS[side] = have
        out.append(have[:n])
    return out[0], out[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64; different seeds give independent hashes."""
    x = x ^ _U((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over slices of about ``most`` bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to, buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


@dataclass
class Words:
    """The words of one step: 64-bit hash, byte span, row within the step; ``first`` is each row's first word."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    raw: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def fold(buf: np.ndarray) -> np.ndarray:
    out = LOWER_BYTE[buf]
    if len(buf) > 1:
        upper = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97))
        out[upper + 1] += 0x20
    return out


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray = WORD_BYTE, folded: bool = True) -> Words:
    """Maximal runs of bytes of a ``kind``, with their case folded or as they are."""
    rows = len(off) - 1
    if not len(buf):
        e = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U), e, e, e, np.zeros(rows + 1, np.int64), buf)
    inside = kind[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashed = np.zeros(len(start), _U)
    at = 0
    while at < len(start):  # whole words of about a step's bytes, so a long text needs no long sums
        to = max(at + 1, int(np.searchsorted(end, start[at] + STEP_BYTES, "right")))
        lo = start[at]
        power, inverse = _powers(int(end[to - 1] - lo) + 1)
        sums = np.zeros(len(power), _U)
        some = buf[lo : end[to - 1]]
        np.cumsum(((fold(some) if folded else some).astype(_U) + _U(1)) * power[:-1], out=sums[1:])
        hashed[at:to] = mix((sums[end[at:to] - lo] - sums[start[at:to] - lo]) * inverse[start[at:to] - lo])
        at = to
    first = np.searchsorted(start, off).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(hashed, start, end, row, first, buf)


def windows(hashes: np.ndarray, first: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words that stays within its row: (hash, row, position of its first word).

    With ``short``, a row of 1 to width-1 words gives one window of all of them.
    """
    n, size = len(hashes), np.diff(first)
    rows = np.repeat(np.arange(len(size)), size)
    if n >= width:
        total = np.zeros(n - width + 1, _U)
        for k in range(width):
            total = (total + hashes[k : n - width + 1 + k]) * _U(_BASE) ^ (total >> _U(29))
        at = np.flatnonzero(rows[: n - width + 1] == rows[width - 1 :])
        out, where = mix(total[at], 5), at
    else:
        out, where = np.zeros(0, _U), np.zeros(0, np.int64)
    row = rows[where] if len(where) else np.zeros(0, np.int64)
    if short and len(few := np.flatnonzero((size > 0) & (size < width))):
        extra = []
        for r in few:
            t = _U(int(size[r]))
            with np.errstate(over="ignore"):
                for h in hashes[first[r] : first[r + 1]]:
                    t = (t + h) * _U(_BASE) ^ (t >> _U(29))
            extra.append(t)
        out = np.concatenate([out, mix(np.array(extra, _U), 7)])
        row, where = np.concatenate([row, few]), np.concatenate([where, first[few]])
        order = np.argsort(row, kind="stable")
        out, row, where = out[order], row[order], where[order]
    return out, row, where


def distinct_by_row(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row and how often each occurs: (hash, row, count)."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h)))


def count_by_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of true bytes of each row."""
    out = np.zeros(len(off) - 1, np.int64)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        out[full] = np.add.reduceat(mask, off[full], dtype=np.int64)
    return out


def sum_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=rows)
