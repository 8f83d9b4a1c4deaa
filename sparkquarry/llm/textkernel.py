"""Vectorised text kernels shared by the corpus operators.

All of them work on the UTF-8 buffer of an Arrow string column, so a batch of
documents is split into words and hashed without a Python object per word.
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 never uses
those bytes inside a longer character, so byte runs equal character runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a Python worker; bounds its memory.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_COMBINE = _rng.integers(1, 1 << 63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 64)
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer text makes a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def run_bounds(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of set bytes; a run never goes beyond its document."""
    cuts = offs[:-1][offs[:-1] < offs[-1]]
    s = inside.copy()
    s[1:] &= ~inside[:-1]
    s[cuts] = inside[cuts]
    e = inside.copy()
    e[:-1] &= ~inside[1:]
    last = cuts[cuts > 0] - 1
    e[last] = inside[last]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words, and for each document the index of its first word (one entry more than documents)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    starts, ends = run_bounds(~SPACE[buf], offs)
    return starts, ends, np.searchsorted(starts, offs, "left")


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint byte spans."""
    out = np.empty(len(starts), U64)
    table, i = _LOWER if lower else _EXACT, 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(table[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(U64) * _COMBINE[63])
        i = j
    return out


def shingles(words: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begin): all ``k``-word shingles in order and, for each document, where its own begin (one entry more).

    ``short``: a document of 1 to ``k - 1`` words gives its whole sequence as one shingle.
    """
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    if short:
        count[(n > 0) & (n < k)] = 1
    begin = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    used = np.repeat(np.minimum(n, k), count)
    h = used.astype(U64) * _COMBINE[62]
    full = bool((used == k).all())
    for j in range(k):
        if full:
            h += words[pos + j] * _COMBINE[j]
        else:
            here = used > j
            h[here] += words[pos[here] + j] * _COMBINE[j]
    return mix(h), begin


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def long_lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """A list<int64> column from flat values and list begins."""
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values))
