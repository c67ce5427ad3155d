"""Vectorised word and byte hashing over Arrow string columns (UTF-8 bytes, no per-word Python)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: An odd multiplier, its inverse modulo 2**64, and the seed of the byte values.
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_SEED = 20240229
BYTE_VALUES = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n of each at least."""
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in _POW:
        _POW.clear()
        a, b = np.full(size, _P, U), np.full(size, _INV, U)
        a[0] = b[0] = 1
        _POW[size] = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _POW[size]


def release() -> None:
    """Gives memory that a worker has freed back to the system; workers outlive the tasks of a stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets into them; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, count=col.offset + len(col) + 1)[col.offset :].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def binary_rows(col: pa.Array, size: int) -> np.ndarray:
    """The bytes of a binary column of values of one size, a row each."""
    data = utf8(col)[0]
    return data.reshape(len(col), size)


def pieces(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a longer row is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """c with c[j] - c[i], times the inverse power at i, the polynomial hash of data[i:j]."""
    p, _ = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * p[: len(data)], out=c[1:])
    return c


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(c))
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(U))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]
#: True for the bytes of words: all but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: True for digits, letters and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def word_places(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[data]
    prev, after = np.empty_like(w), np.empty_like(w)
    prev[0], prev[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    cuts = offs[:-1][offs[:-1] < len(data)]
    prev[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(w & ~prev), np.flatnonzero(w & ~after) + 1


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (A-Z lower-cased) of all words, the row of each, and n + 1 offsets of the rows' words."""
    n = len(offs) - 1
    start, end = word_places(data, offs, is_word)
    h = range_hash(prefix_hash(data, LOWER_VALUES), start, end)
    at = np.searchsorted(start, offs)
    row = np.repeat(np.arange(n), np.diff(at))
    return h, row, at


_C = mix(np.arange(1, 33, dtype=np.uint64)) | U(1)


def windows(h: np.ndarray, at: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of k words that lies in one row."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    m = len(h) - k + 1
    start = np.flatnonzero(row[:m] == row[k - 1 :])
    x = np.zeros(m, U)
    for i in range(k):
        x += h[i : m + i] * _C[i]
    return start, mix(x[start] + U(k))


def distinct_shingles(h: np.ndarray, row: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, ascending, and n + 1 offsets; a row of fewer words, but not none, has
    its whole sequence as one."""
    n = len(at) - 1
    start, s = windows(h, at, row, k)
    r = row[start]
    count = np.diff(at)
    for m in range(1, k):
        few = np.flatnonzero(count == m)
        if len(few):
            x = np.zeros(len(few), U)
            for i in range(m):
                x += h[at[few] + i] * _C[i]
            s, r = np.concatenate([s, mix(x + U(m))]), np.concatenate([r, few])
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[keep], r[keep]
    return s, np.searchsorted(r, np.arange(n + 1))
