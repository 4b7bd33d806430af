"""Vectorised text kernel shared by the corpus operators.

Texts arrive as Arrow string columns.  All work is done on the UTF-8 bytes of
a whole group of texts at once, so the cost per word is that of a few numpy
passes.  A *word* is a maximal run of ASCII letters, digits and bytes >= 0x80
of the lower-cased text; everything else separates.  Bytes are worked on in
pieces of ``PIECE``, which keeps the memory of a task bounded however long a
text is; a word that spans several pieces is one word.

Nulls and empty texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULT = 0x9E3779B97F4A7C15
_INV = pow(MULT, -1, 1 << 64)
PIECE = 1 << 20
_MASK = (1 << 64) - 1

WORD = np.zeros(256, bool)
WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def mix_one(h: int) -> int:
    """``mix`` for one Python integer."""
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & _MASK
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & _MASK
    return h ^ (h >> 33)


def hash_word(word: bytes) -> int:
    """Hash of one lower-cased word; the scalar form of what ``words`` computes."""
    return mix_one(sum((b + 1) * pow(MULT, i, 1 << 64) for i, b in enumerate(word)) & _MASK)


def split_words(text: str | None) -> list[bytes]:
    """Words of one text; the scalar form of ``words``."""
    out, at = [], -1
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    for i, b in enumerate(data):
        if WORD[b]:
            at = i if at < 0 else at
        elif at >= 0:
            out.append(data[at:i])
            at = -1
    return out + ([data[at:]] if at >= 0 else [])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    size = len(column)
    if not size or data is None:
        return np.zeros(0, np.uint8), np.zeros(size + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, size + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of about ``target`` bytes (one row at least)."""
    size = len(column)
    if not size:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    cut, lo, total = np.cumsum(lengths), 0, 0
    while lo < size:
        hi = max(lo + 1, int(np.searchsorted(cut, total + target, "right")))
        yield lo, hi
        lo, total = hi, int(cut[hi - 1])


def give_back() -> None:
    """Returns freed memory to the system: a worker process serves one stage after the other and would keep what each had at its peak."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc's
        trim(0)


@dataclass
class Words:
    """Words of some texts, in order: hash, row of the text, byte range in ``data``."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def bounds(self) -> np.ndarray:
        """First word of each row, and the number of words as last item."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def _pieces(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, size = 0, len(data)
    while lo < size:
        hi = min(lo + PIECE, size)
        if hi < size:
            gaps = np.flatnonzero(~inside[max(lo, hi - 4096) : hi])
            if not len(gaps):
                gaps = np.flatnonzero(~inside[lo:hi])
                hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
            else:
                hi = max(lo, hi - 4096) + int(gaps[-1]) + 1
        yield lo, hi
        lo = hi


def words(column: pa.Array, lower: bool = True) -> Words:
    """Tokenises a column; see the module's text for what a word is."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = raw(pc.utf8_lower(column) if lower else column)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inside = WORD[data]
    found: list[tuple[np.ndarray, ...]] = []
    open_ = (0, 0, 0)  # of a word that goes on in the next piece: sum so far, bytes so far, first byte
    for lo, hi in _pieces(data, inside):
        w, n = inside[lo:hi], hi - lo
        begin = w.copy()
        begin[1:] &= ~w[:-1] | first[lo + 1 : hi]
        finish = w.copy()
        finish[:-1] &= ~w[1:] | first[lo + 1 : hi]
        start, last = np.flatnonzero(begin), np.flatnonzero(finish)
        part = (data[lo:hi].astype(np.uint64) + np.uint64(1)) * _power("up", MULT, n)[:n]
        total = np.cumsum(part, dtype=np.uint64)
        sums = (total[last] - total[start] + part[start]) * _power("down", _INV, n)[start]
        start, last = start + lo, last + (lo + 1)
        if open_[1]:
            sums[0] = np.uint64((open_[0] + int(sums[0]) * pow(MULT, open_[1], 1 << 64)) & _MASK)
            start[0] = open_[2]
        goes_on = hi < len(data) and inside[hi - 1] and inside[hi] and not first[hi]
        open_ = (int(sums[-1]), int(last[-1] - start[-1]), int(start[-1])) if goes_on else (0, 0, 0)
        keep = len(sums) - goes_on
        found.append((mix(sums[:keep]), start[:keep], last[:keep]))
    if not found:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, data, offsets)
    h, start, end = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(h, row, start, end, data, offsets)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within each row, and their rows.

    A row with fewer words than ``size`` (but any) has one shingle of all its words.
    """
    h, row = w.hash, w.row
    if size == 1 or not len(h):
        return h, row
    acc = h.copy()
    n = len(h)
    length = np.bincount(row, minlength=w.rows)
    for k in range(1, size):
        ok = np.zeros(n, bool)
        ok[: n - k] = row[: n - k] == row[k:]
        nxt = np.zeros(n, np.uint64)
        nxt[: n - k] = h[k:]
        acc = np.where(ok, mix(acc * np.uint64(3) + nxt), acc)
    place = np.arange(n) - np.searchsorted(row, row)
    keep = place <= np.maximum(length[row] - size, 0)
    return acc[keep], row[keep]


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs in order, with their counts."""
    if not len(h):
        return h, row, np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))
