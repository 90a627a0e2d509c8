"""Vectorised kernels over UTF-8 bytes.

A batch of texts is one byte array plus document offsets, taken straight from
Arrow buffers, so no Python string is made for words or windows. Hashes are
64-bit; arithmetic wraps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
UNBASE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes worked on at a time; longer single texts make a larger slice.
SLICE = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * BASE)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """``base ** i`` for i below n; the longest table so far is kept."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(1 << max(16, (n - 1).bit_length()), base)
        known[:1] = 1
        _POWERS[int(base)] = known = np.multiply.accumulate(known)
    return known[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) of consecutive row ranges of
    about ``limit`` bytes."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of code(data[j]) * BASE**j for j < i."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODES[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of bounds, the same wherever it stands."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), UNBASE)[start])


def words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes outside ``breaks``;
    ``at`` are document offsets, which runs don't cross."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end of every word."""
    start, end, doc = words(data, at, breaks)
    return span_hash(prefix_hash(data), start, end), doc, start, end


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and offsets by document. A document
    with fewer words has its whole sequence as its one shingle; without words none."""
    count = np.bincount(doc, minlength=n_docs).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(n_docs), made)
    start = first[owner] + (np.arange(at[-1]) - at[owner])
    length = np.minimum(size, count[owner])
    out = np.zeros(at[-1], U)
    for k in range(size):
        has = length > k
        if has.all():
            out = out * BASE + hashes[start + k]
        else:
            out[has] = out[has] * BASE + hashes[start[has] + k]
    return mix(out + length.astype(U) * U(0xD6E8FEB86659FD93)), at
