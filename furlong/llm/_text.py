"""Vectorised words, word hashes and shingles over Arrow text columns.

Words are maximal runs of bytes other than space and ``\\x09``-``\\x0D``, with
A-Z lower-cased, as in ``[^\\x20\\x09-\\x0D]+``.  In UTF-8 all these separators
are single bytes that never occur inside another character, so a byte scan of
the Arrow buffer gives the same words as a scan of the characters.

A word's hash is a polynomial over the bytes modulo 2**64, taken from prefix
sums so that it costs a few numpy operations a byte, followed by a mixing step.
Work goes in segments of about ``SEGMENT`` bytes cut at separators; the memory
needed does not follow the length of a text beyond 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
SHINGLE = 5

_P = 0x9E3779B97F4A7C15 | 1
_LOW = 1 << 12
_M64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base & _M64
    return out


_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to twice a segment's length."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        low = _powers(base, _LOW)
        high = _powers(pow(base, _LOW, 1 << 64), max(n, 2 * SEGMENT) // _LOW + 1)
        have = (high[:, None] * low[None, :]).ravel()
        if n <= 2 * SEGMENT:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_WINDOW = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], (off - off[0]) if len(off) else np.zeros(1, np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more at the end)."""
    hashes, begins = [], []
    at, n = 0, len(data)
    texts = offsets[:-1][np.diff(offsets) > 0]
    while at < n:
        stop = min(n, at + SEGMENT)
        while stop < n:  # to the next separator or start of a text
            ahead = data[stop : stop + SEGMENT]
            cut = np.flatnonzero(_SEP[ahead])
            cut = stop + int(cut[0]) if len(cut) else stop + len(ahead)
            t = np.searchsorted(texts, stop)
            if t < len(texts) and texts[t] <= cut:
                stop = int(texts[t])
                break
            stop = cut
            if stop < n and _SEP[data[stop]]:
                break
        seg = data[at:stop]
        word = ~_SEP[seg]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inside = texts[np.searchsorted(texts, at) : np.searchsorted(texts, stop)] - at
        first[inside] = word[inside]
        inside = inside[inside > 0]
        last[inside - 1] = word[inside - 1]
        b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTE[seg] * _power(_P, len(seg)), out=total[1:])
        h = (total[e] - total[b]) * _power(_P_INV, len(seg))[b]
        hashes.append(mix(h))
        begins.append(b + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(begin, offsets)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer words than ``size`` has its whole sequence as one shingle;
    one without words (or null) has none.
    """
    weights = _WINDOW if size == SHINGLE else mix(np.arange(1001, 1001 + size, dtype=np.uint64)) | np.uint64(1)
    for lo, hi, data, offsets in pieces(column):
        words, first = word_hashes(data, offsets)
        n = len(words) - size + 1
        if n > 0:
            windows = words[:n] * weights[0]
            for j in range(1, size):
                windows += words[j : n + j] * weights[j]
            windows = mix(windows)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                s = np.sort(windows[a : b - size + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix((words[a:b] * weights[: b - a]).sum(dtype=np.uint64).reshape(1) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def pieces(column: pa.Array, most: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: (first row, last row + 1, bytes, offsets)."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
