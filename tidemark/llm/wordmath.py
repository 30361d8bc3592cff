"""Vectorised word hashing over Arrow string buffers.

A word is a maximal run of bytes other than ASCII white space.  All hashes are
64-bit polynomial sums with wrap-around, taken from prefix sums, so one numpy
pass serves a whole batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_B1 = np.uint64(0x9E3779B97F4A7C15 | 1)
_B2 = np.uint64(0xD6E8FEB86659FD93 | 1)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _inverse(x: np.uint64) -> np.uint64:
    a, inv = int(x), 1
    for _ in range(6):
        inv = inv * (2 - a * inv) % (1 << 64)
    return np.uint64(inv)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, _inverse(base)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.base, dtype=np.uint64)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.inv, dtype=np.uint64)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_P1, _P2 = _Powers(_B1), _Powers(_B2)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each row's words begin (rows + 1 values).

    Works through pieces of about a megabyte that end at white space or at a
    row's end, so memory follows the piece and not the batch.
    """
    n, out, counts = len(raw), [], np.zeros(len(offsets) - 1, dtype=np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    lo = 0
    while lo < n:
        hi = min(n, lo + SEGMENT)
        if hi < n:
            cut = _GAP[raw[lo:hi]] | first[lo:hi]
            cut[0] = False
            back = np.flatnonzero(cut)
            if len(back):
                hi = lo + int(back[-1])
            else:
                while hi < n and not (_GAP[raw[hi]] or first[hi]):
                    hi += 1
        part = raw[lo:hi]
        gap = _GAP[part]
        before = np.empty(len(part), dtype=bool)
        before[0], before[1:] = True, gap[:-1]
        before |= first[lo:hi]
        begin = ~gap & before
        starts = np.flatnonzero(begin)
        after = np.empty(len(part), dtype=bool)
        after[-1], after[:-1] = True, gap[1:] | first[lo + 1 : hi]
        ends = np.flatnonzero(~gap & after) + 1
        with np.errstate(over="ignore"):
            up, down = _P1.upto(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[_LOWER[part] if lower else part] * up[: len(part)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _B2
        out.append(mix(h))
        if len(starts):
            rows = np.searchsorted(offsets, starts + lo, side="right") - 1
            counts += np.bincount(rows, minlength=len(counts))
        lo = hi
    words = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return words, np.concatenate([[0], np.cumsum(counts)])


def grams(words: np.ndarray, q: int, second: bool = False) -> np.ndarray:
    """Hash of each run of ``q`` words; row borders are the caller's affair."""
    n = len(words) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = (_P2 if second else _P1).upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix((sums[q:] - sums[: n]) * down[:n])


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """``op`` over each ``w`` neighbours, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, y = 1, x
    while have * 2 <= w:
        y = op(y[:-have], y[have:])
        have *= 2
    return op(y[:n], y[w - have : w - have + n])


def slices(offsets: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi
