"""Vectorised word splitting and hashing over whole Arrow string columns.

Text is lower-cased by Arrow, and word borders and 64-bit word hashes are computed with
numpy over the UTF-8 bytes of a whole batch: no Python object per word is made.  Memory is
bounded by :func:`row_slices` (rows per step) and by hashing in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
STEP_BYTES = 1 << 22

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table() -> np.ndarray:
    word = np.zeros(256, bool)
    word[0x80:] = True
    for lo, hi in (("0", "9"), ("a", "z"), ("A", "Z")):
        word[ord(lo) : ord(hi) + 1] = True
    return word


_WORD = _table()
_VAL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have[:n]


class Words(NamedTuple):
    """``hash``: of each word; ``first``: index of each row's first word, and the total."""

    hash: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _borders(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of every word; rows: byte offset of each row's begin."""
    n = len(buf)
    word = _WORD[buf]
    hi = np.flatnonzero(buf >= 0xC2)
    lead = buf[hi]
    two = hi[lead == 0xC2]
    word[two] = False
    word[np.minimum(two + 1, n - 1)] = False
    three = hi[lead == 0xE2]
    three = three[(buf[np.minimum(three + 1, n - 1)] & 0xFE) == 0x80]
    ideo = hi[(lead >= 0xE3) & (lead <= 0xE9)]
    marks = ideo[(buf[ideo] == 0xE3) & (buf[np.minimum(ideo + 1, n - 1)] == 0x80)]
    for k in range(3):
        word[np.minimum(three + k, n - 1)] = False
        word[np.minimum(marks + k, n - 1)] = False
    edge = np.empty(n + 1, bool)  # a border lies before this byte
    edge[0] = edge[n] = True
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    edge[rows[rows < n]] = True
    edge[ideo] = True  # scripts without spaces: each character is a word
    edge[np.minimum(ideo + 3, n)] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = word[starts]
    return starts[keep], ends[keep]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a string column, and where each row begins in them, and the end."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    buf = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
    return buf, off - off[0]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = _VAL) -> np.ndarray:
    """A 64-bit hash of each word's bytes; value: what each byte counts as."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        b = ends[j - 1]
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum(value[buf[a:b]] * _power(_P, b - a), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * _power(_PINV, b - a + 1)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def words(col: pa.Array) -> Words:
    """Words of each row of a string column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    buf, off = utf8(pc.utf8_lower(col))
    if not len(buf):
        return Words(np.empty(0, np.uint64), np.zeros(len(off), np.int64))
    starts, ends = _borders(buf, off[:-1])
    return Words(word_hashes(buf, starts, ends), np.searchsorted(starts, off))


def hash_words(text: str) -> np.ndarray:
    return words(pa.array([text], pa.string())).hash


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n words; a row with 1 to n-1 words has one run of them all."""
    h, row = w.hash, w.row()
    short = (w.counts() > 0) & (w.counts() < n)
    if len(h) >= n:
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g *= np.uint64(_P)
            g += h[k : len(h) - n + 1 + k]
        ok = row[: len(h) - n + 1] == row[n - 1 :]
        g, r = mix(g[ok]), row[: len(h) - n + 1][ok]
    else:
        g, r = np.empty(0, np.uint64), np.empty(0, np.int64)
    if short.any():
        which = np.flatnonzero(short)
        extra = sequence_hash(w)[which]
        g, r = np.concatenate([g, extra]), np.concatenate([r, which])
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    return g, r


def sequence_hash(w: Words) -> np.ndarray:
    """One hash for each row's whole sequence of words; 0 for a row without words."""
    out = np.zeros(len(w.first) - 1, np.uint64)
    n = w.counts()
    some = n > 0
    if some.any():
        k = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
        weight = mix(k.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(7)) | np.uint64(1)
        out[some] = mix(np.add.reduceat(mix(w.hash * weight), w.first[:-1][some]) + n[some].astype(np.uint64))
    return out


def row_slices(col: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text, at least one row each."""
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    begin, total = 0, 0
    for i, s in enumerate(size.tolist()):
        if i > begin and total + s > limit:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(size):
        yield begin, len(size)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j in row_slices(b.column(column), limit):
            yield b.slice(i, j - i)


def spans(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words h[begin:end] for each begin and end."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * _power(_P, len(h)), out=total[1:])
    return mix((total[end] - total[begin]) * _power(_PINV, len(h) + 1)[begin] + (end - begin).astype(np.uint64))
