"""Vectorised text primitives on Arrow string arrays: words, word hashes, shingle sets.

A word is a run of ASCII letters, digits and non-ASCII characters of the lower-cased text. Its hash is a polynomial
of its bytes modulo 2^64, mixed; all words of a chunk are hashed at once from one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 18  # vectorised work takes about 30 times as much memory

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(n, base, U64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def as_string(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls read as empty."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes, at least a row each; bounds the memory of vectorised work."""
    _, off = buffers(arr)
    at, n = 0, len(arr)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets by row)."""
    data, off = buffers(pc.utf8_lower(arr))
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(arr) + 1, np.int64)
    inside = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)
    begins = at[:-1][inside[at[:-1]]]
    ends = at[1:][inside[at[:-1]]]
    h, i = np.empty(len(begins), U64), 0
    while i < len(begins):  # whole words of about CHUNK_BYTES at a time, as a text may be long
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + 2 * CHUNK_BYTES, "right")))
        first = begins[i]
        b, e = begins[i:j] - first, ends[i:j] - first
        size = int(e[-1])
        up, down = _pow(size + 1)
        total = np.empty(size + 1, U64)
        total[0] = 0
        np.cumsum((data[first : first + size].astype(U64) + U64(1)) * up[:size], out=total[1:])
        h[i:j] = mix((total[e] - total[b]) * down[b] + (e - b).astype(U64))
        i = j
    return h, np.searchsorted(begins, off, "left")


def shingle_sets(arr: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's runs of k words; of all its words where it has fewer; none without words."""
    h, off = words(arr)
    n = len(h)
    rolled = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        rolled *= U64(_BASE)
        rolled += h[j : n - k + 1 + j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            v = U64(b - a)
            for x in h[a:b]:
                v = U64((int(v) * _BASE + int(x)) & 0xFFFFFFFFFFFFFFFF)
            s = mix(np.array([v], U64))
        else:
            s = np.zeros(0, U64)
        out.append(s)
    return out
