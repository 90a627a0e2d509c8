"""Lower-cased letter runs and their hashed byte n-grams, for classifiers."""

from __future__ import annotations

import numpy as np

from . import text as tx

#: Bytes outside words: everything in ASCII but letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and U+00C0..U+00DE in lower case, bytes outside words as spaces."""
    out = tx.LOWER[data]
    out[NOT_LETTER[data]] = 32
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def letter_runs(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tx.words(low, at, NOT_LETTER)


def framed(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every word with a space before and after it, joined, and the offsets."""
    size = end - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], 32, np.uint8)
    inner = np.repeat(start - np.arange(len(start)) * 2 - (at[:-1] - np.arange(len(start)) * 2) - 1, size) + np.arange(at[-1])
    body = np.ones(at[-1], bool)
    body[at[:-1]] = body[at[1:] - 1] = False
    out[body] = low[inner[body]]
    return out, at


def grams(frame: np.ndarray, at: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram inside a framed word, and the offsets by word.
    Shorter words have none of this size."""
    length = np.diff(at)
    count = np.maximum(length - size + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    key = np.zeros(max(0, len(frame) - size + 1), np.uint32)
    for j in range(size):
        key = key * np.uint32(0x01000193) ^ frame[j : j + len(key)]
    key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    bucket = (key >> np.uint32(32 - bits)).astype(np.int32)
    keep = np.ones(len(bucket), bool)
    for j in range(1, size):
        tail = at[1:] - j
        keep[tail[(tail >= 0) & (tail < len(keep))]] = False
    return bucket[keep], begin
