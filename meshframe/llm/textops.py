"""Vectorised text kernels over UTF-8 buffers: words, rolling hashes, minimizer anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at once; a longer text is a slice of its own.
SLICE = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _class_table(separators: list[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[separators] = False
    return table


#: Bytes of words [^\x20\x09-\x0D]+
SPACED = _class_table([0x20, *range(0x09, 0x0E)])
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, upper-case letters not yet lowered
ALNUM = _class_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Lowers A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, on a copy."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse; only the longest made so far are kept."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, n + 1 + (n >> 3))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = np.cumprod(up), np.cumprod(down)
    return _powers[0][: n + 1], _powers[1][: n + 1]


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240611)).integers(1, _MASK, 256, np.uint64, True)


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base^position, modulo 2^64."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) from prefix sums; equal contents have equal hashes."""
    _, down = powers(len(pre) - 1)
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def grams_hash(pre: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values."""
    n = len(pre) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(len(pre) - 1)
    return mix((pre[k:] - pre[:-k]) * down[:n])


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words; words never cross rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    before[cuts] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words; the working memory does not grow with the text, nor with a word."""
    out = np.zeros(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + SLICE, "right")))
        if end[b - 1] - start[a] <= 2 * SLICE:
            lo = start[a]
            out[a:b] = spans_hash(prefix(byte_values()[buf[lo : end[b - 1]]]), start[a:b] - lo, end[a:b] - lo)
        a = b
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys, by doubling."""
    if len(keys) < w:
        return keys[:0]
    out, size = keys, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(grams: np.ndarray, row: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of `window` units: position, first and last start of the windows that own it.

    The anchor of a window is its leftmost k-gram of least hash, so equal windows have their anchor at the same
    place. grams: hashes of all k consecutive units of a slice; row: the row of each unit.
    """
    n = len(row) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    low = np.uint64(0xFFFFFFFF)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (window_min(keys, window - k + 1)[:n] & low).astype(np.int64)
    starts = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    at = at[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    return at[new], starts[new], starts[last]
