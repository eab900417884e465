"""Numpy kernels over the UTF-8 bytes of Arrow string columns, shared by the operators on words and bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
#: Bytes of text that a kernel works on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ U(salt)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A 64-bit value for each byte, so that short strings already use the whole width.
LETTERS = mix(np.arange(1, 257, dtype=U), 0xA5A5)


@lru_cache(maxsize=8)
def powers(n: int, base: int = int(BASE)) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse power, i < n, modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        x = np.full(n, U(b))
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def room(n: int) -> int:
    """The next power of two, so that few sizes of power tables are kept."""
    return 1 << max(20, int(n).bit_length())


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = sum of values[i] * base**i over s <= i < e."""
    h = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(room(len(values)))[0][: len(values)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that doesn't depend on where they stand."""
    return (h[end] - h[start]) * powers(room(len(h)))[1][start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and the offsets of its rows (one more than rows)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of words before it (one more than rows).

    Words are runs of bytes other than space, tab, \\n, \\v, \\f and \\r, which in UTF-8 is the same as of code points; a
    row's end also ends a word. ``data`` begins at offsets[0].
    """
    rel = offsets - offsets[0]
    space = _space[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[rel] = True
    before = np.ones(len(data), dtype=bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first[:-1]))
    after = np.ones(len(data), dtype=bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, rel)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _lower[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = prefix_hash(LETTERS[data])
    return mix(span_hash(h, starts, ends) + (ends - starts).astype(U))


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row its distinct k-word shingles' hashes, sorted: all words as one where it has fewer than k."""
    factors = mix(np.arange(1, k + 1, dtype=U), 0x5151)
    n = len(hashes)
    whole = np.zeros(max(n - k + 1, 0), dtype=U)
    for j in range(k if len(whole) else 0):
        whole += hashes[j : n - k + 1 + j] * factors[j]
    whole = mix(whole)
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            yield mix((hashes[a:b] * factors[: b - a]).sum(keepdims=True, dtype=U), b - a)
        else:
            yield whole[:0]
