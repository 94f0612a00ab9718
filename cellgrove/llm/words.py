"""Words and rolling hashes of UTF-8 text as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D; all bytes of a
multi-byte character are outside that set, so words of bytes are words of
characters. Everything works on the concatenated buffer of an Arrow string
column plus the offsets of its rows, so no Python string is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLOCK = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240613)).integers(1, 2**64, 256, dtype=U64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, made as far as they are asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, _BLOCK + 1)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_CHARS = _Powers(int(_BASE))
_GRAMS = _Powers(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finalizer)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    kind = np.int64 if large else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of rows of at most `most` bytes together, a longer row by itself."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row."""
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = ~separator[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that are in order and don't overlap; equal bytes give equal hashes."""
    out = np.empty(len(starts), dtype=U64)
    i, n = 0, len(starts)
    while i < n:
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        part = buf[at : ends[j - 1]]
        up, down = _CHARS.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * _BASE
        i = j
    return mix(out)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.empty(n, dtype=U64)
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        part = hashes[a : b + k - 1]
        up, down = _GRAMS.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[a:b] = (sums[k : k + b - a] - sums[: b - a]) * down[: b - a]
    return mix(out)


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For every window of w values the place of its least, by the upper 32 bits, the leftmost of equals.

    Equal windows choose the same place relative to their start, wherever they
    stand: that makes the choice an anchor of the content.
    """
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = U64(0xFFFFFFFF)
    keys = (values & ~low) | np.arange(len(values), dtype=U64)
    full = np.concatenate([keys, np.full(-len(values) % w, np.iinfo(np.uint64).max, dtype=U64)]).reshape(-1, w)
    fore = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], fore[w - 1 : w - 1 + n]) & low).astype(np.int64)


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of `length` items that lie within one row; first: the number of items before each row."""
    n = int(first[-1])
    ok = np.zeros(max(n, 1), dtype=bool)[:n]
    if n >= length:
        ok[: n - length + 1] = True
        for at in first[1:-1]:
            ok[max(0, at - length + 1) : at] = False
    return np.flatnonzero(ok)


def range_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [a, b) of values, which may overlap; equal sequences give equal hashes."""
    up, down = _GRAMS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * _BASE)


def covered(starts: np.ndarray, counts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of `width` items that starts at starts[i] .. starts[i] + counts[i] - 1."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts + width - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0
