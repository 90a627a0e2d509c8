"""Exchange of many small keyed entries as packed columns.

Some operators give several entries for every few words of the corpus. A row
for each would cost far more than the entry itself, so a task sorts its entries
by key and sends, for each bucket (a range of hashed keys), one row that holds
the entries as compressed byte planes; sorted keys are stored as differences, whose
high planes are zero. Spark shuffles the rows by
bucket, and whoever reads a bucket gets all entries of its keys. The number of
buckets follows the number of input splits, so a bucket's size doesn't grow with
the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

U = np.uint64


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hashed key; in the keys' order."""
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def pack(columns: Sequence[np.ndarray]) -> bytes:
    """Columns of one length, the first sorted; their dtypes are the reader's to know."""
    first = columns[0].astype(U)
    first[1:] -= columns[0][:-1].astype(U)
    planes = [c.view(np.uint8).reshape(len(c), c.itemsize).T.ravel() for c in map(np.ascontiguousarray, (first, *columns[1:]))]
    return squeeze(np.concatenate(planes).tobytes())


def squeeze(data: bytes) -> bytes:
    """Compressed bytes behind their own length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def unpack(payload: bytes, dtypes: Sequence[type]) -> list[np.ndarray]:
    kinds = [np.dtype(d) for d in dtypes]
    data = np.frombuffer(unsqueeze(payload), np.uint8)
    n, at, out = len(data) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        planes = data[at : at + n * k.itemsize].reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(k))
        at += n * k.itemsize
    out[0] = np.cumsum(out[0], dtype=U)
    return out


def unpack_all(payloads: Sequence[bytes], dtypes: Sequence[type]) -> list[np.ndarray]:
    """Entries of several payloads, one after another."""
    parts = [unpack(p, dtypes) for p in payloads if p]
    if not parts:
        return [np.zeros(0, d) for d in dtypes]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def scatter(columns: Sequence[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) for columns whose first is sorted."""
    if not len(columns[0]):
        return
    bucket = bucket_of(columns[0], buckets)
    at = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield int(bucket[i]), pack([c[i:j] for c in columns])


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, over columns of one length."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) of one star for each component of the edges (a, b);
    the root is the smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[child]], nodes[child]
