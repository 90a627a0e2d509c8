"""Byte-level BPE encoding and decoding (operator 3).

A text is cut at special tokens, then by the byte-level pattern into pieces.
Each piece is a doubly linked list of byte symbols; a heap holds (rank, place)
of every mergeable neighbour pair, an entry whose symbols have changed since is
skipped when popped, and each merge pushes the pairs it creates. Decoding joins
the vocabulary's byte strings. Pieces repeat, so each worker keeps the ids of
up to ``CACHE`` pieces, and starts again when that is full.

Null text encodes as empty: no ids. Very long texts are one row each, and need
memory in proportion to their own length. Repeated rows give repeated results;
an empty table none; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

#: The published byte-level pattern; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps.
CACHE = 800_000
#: Pieces longer than this are not kept.
LONG = 64


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A tokenizer read from a ``tokenizers`` JSON file with a byte-level BPE
    model and no normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *special.items()]:
            self.strings[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.byte_ids = [vocab[c] for c, _ in sorted(letter.items(), key=lambda x: x[1])]
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            self.left.append(vocab[x])
            self.right.append(vocab[y])
            self.made.append(vocab[x + y])
            self.rank.setdefault(vocab[x] << 32 | vocab[y], rank)
        self.pieces = regex.compile(PATTERN)
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known = _Known(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. Heap entries are rank << 32 | place; a symbol that
        was merged into its left neighbour has id -1."""
        byte_ids, find, left, right, made = self.byte_ids, self.rank.get, self.left, self.right, self.made
        ids = [byte_ids[b] for b in piece]
        n = len(ids)
        heap = []
        for i in range(n - 1):
            if (r := find(ids[i] << 32 | ids[i + 1])) is not None:
                heap.append(r << 32 | i)
        if not heap:
            return ids
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if ids[i] != left[r] or (j := after[i]) >= n or ids[j] != right[r]:
                continue  # stale
            ids[i], ids[j] = new, _ = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := find(new << 32 | ids[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := find(ids[h] << 32 | new)) is not None:
                heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.known
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(known.__getitem__, self.pieces.findall(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(known.__getitem__, self.pieces.findall(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Known(dict):
    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """Read once in each worker process."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, token_ids
    (binary, little-endian unsigned 32-bit) of every whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                encoded = [bpe.encode(t or "") for t in part.column(names.index("text")).to_pylist()]
                columns = {
                    "doc_id": part.column(names.index("doc_id")),
                    "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in encoded]),
                }
                if ids:
                    columns["token_ids"] = pa.array(encoded, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encode``'s doc_id and token_ids; null ids read as none."""
    prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            text = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(text, pa.string())})

    return tokens.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, text string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe_encoding(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)
