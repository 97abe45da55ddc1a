"""Vectorised text primitives shared by the corpus operators.

Everything works on whole Arrow batches: a string column becomes one byte buffer
and word boundaries, hashes and n-gram hashes are computed with numpy over that
buffer, so no operator loops over characters or words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NONWORD = np.ones(256, dtype=bool)
_NONWORD[48:58] = _NONWORD[65:91] = _NONWORD[97:123] = _NONWORD[128:] = False
_pow_cache: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _pow_cache.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.ones(size, dtype=np.uint64)
        filled = 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            out[filled : 2 * filled] = out[:filled] * step
            filled *= 2
        _pow_cache[key] = have = out
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3 constants), element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def string_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch of texts: runs of non-white-space bytes or, with alnum,
    runs of ASCII letters, digits and non-ASCII bytes.

    start, end: byte bounds of each word in ``data``; row: number of its text;
    first: n+1 word offsets, text i has words first[i]..first[i+1]-1.
    """

    __slots__ = ("data", "offsets", "start", "end", "row", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alnum: bool = False):
        n, rows = len(data), len(offsets) - 1
        self.data, self.offsets = data, offsets
        if n == 0:
            self.start = self.end = self.row = np.zeros(0, np.int64)
            self.first = np.zeros(rows + 1, np.int64)
            return
        solid = ~(_NONWORD if alnum else _SPACE)[data]
        edge = np.zeros(n + 1, dtype=bool)
        inner = offsets[(offsets > 0) & (offsets < n)]
        edge[inner] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:n]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))

    def hashes(self, fold: bool = True) -> np.ndarray:
        """64-bit content hash of every word; ASCII letters are lowered if fold."""
        if len(self.start) == 0:
            return np.zeros(0, np.uint64)
        data = self.data
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
        run = data.astype(np.uint64) + np.uint64(1)
        run *= _powers(_BASE, len(data), "p")
        np.cumsum(run, out=run)
        total = run[self.end - 1]
        total[self.start > 0] -= run[self.start[self.start > 0] - 1]
        total *= _powers(_INV, len(data), "i")[self.start]
        return mix64(total + (self.end - self.start).astype(np.uint64))


def words_of(col, alnum: bool = False) -> Words:
    return Words(*string_buffer(col), alnum)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (length len-n+1), order-sensitive."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    run = hashes * _powers(_BASE, len(hashes), "p")
    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(run)])
    return mix64((cum[n:] - cum[:-n]) * _powers(_INV, len(hashes), "i")[:m])


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
