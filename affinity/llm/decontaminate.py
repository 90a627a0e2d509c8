"""Benchmark decontamination (operator 5).

Word trigrams of test items that are rare are seeds: their expected count in the
corpus, from the frequencies of their words, is at most ``EXPECTED``, or they are
in the rarer half of their item's (so every item has seeds, however often it
leaked). A pass over the corpus counts the items' words; a second finds seeds in
whole texts, and around them aligns item and text by Smith-Waterman over words
(match 2, mismatch and gap -1). The score is the best alignment's share of the
item's perfect score; copies with words changed, left out or put in keep most of
it. Matches of at least ``threshold`` are returned.

An alignment also has to reach ``FLOOR``, or the item's perfect score where that is less:
three words in a row do for any item, and items of one to three words are found only as
they are. (A one-word item is thus found wherever its word is.) Items of fewer than
``SHORT`` words have all their word pairs as seeds, rare or not, as one changed word can
leave them no trigram. Items are sent to the tasks in blocks of at most ``BLOCK`` bytes, one pass each, so
nothing of unknown size is broadcast. Null and wordless items have nothing to search.
Null and empty texts match nothing. Repeated ids, of
items or documents, give the best score of their rows. Empty tables give no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import prepare, table
from .exchange import run_starts

U = np.uint64
GRAM, SHORT, FLOOR, EXPECTED, BLOCK = 3, 8, 6, 1.0, 8 << 20
#: Bytes outside words: ASCII but letters and digits.
BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def hashed_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tx.word_hashes(tx.LOWER[data], at, BREAKS)


@dataclass
class Member:
    """Fast test for a bounded set of hashes."""

    values: np.ndarray  # sorted

    def __post_init__(self):
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.values >> U(42)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x that hold a member, and which one."""
        at = np.flatnonzero(self.filter[(x >> U(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.values, x[at]), max(0, len(self.values) - 1))
        hit = self.values[k] == x[at] if len(self.values) else np.zeros(len(at), bool)
        return at[hit], k[hit]


@dataclass
class Items:
    ids: np.ndarray
    words: list[np.ndarray]

    @staticmethod
    def of(rows: list) -> Items:
        data, at = tx.buffers(pa.array([r.text for r in rows], pa.string()))
        hashes, doc, _, _ = hashed_words(data, at)
        cuts = np.searchsorted(doc, np.arange(len(rows) + 1))
        words = [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        keep = [k for k, w in enumerate(words) if len(w)]
        return Items(np.array([rows[k].item_id for k in keep], np.int64), [words[k] for k in keep])

    def seeds(self, counts: dict[int, int], total: int) -> dict[int, tuple[Member, np.ndarray, np.ndarray]]:
        """By number of words the grams of items (all of short ones, the rare ones of others);
        for each gram (by offset) the items that have it."""
        grams: dict[int, tuple[list, list]] = {}
        for k, w in enumerate(self.words):
            size = GRAM if len(w) >= SHORT else min(2, len(w))
            g, _ = tx.shingles(w, np.zeros(len(w), np.int64), 1, size)
            if size == GRAM:
                g = g[self.rare(w, counts, total)]
            gram, owner = grams.setdefault(size, ([], []))
            gram.append(np.unique(g))
            owner.append(np.full(len(gram[-1]), k))
        return {size: indexed(np.concatenate(gram), np.concatenate(owner)) for size, (gram, owner) in grams.items()}

    @staticmethod
    def rare(w: np.ndarray, counts: dict[int, int], total: int) -> np.ndarray:
        p = np.array([max(1, counts.get(int(x), 0)) for x in w]) / max(1, total)
        expected = total * np.prod([p[i : len(p) - GRAM + 1 + i] for i in range(GRAM)], axis=0)
        return (expected <= EXPECTED) | (expected <= np.median(expected))


def indexed(gram: np.ndarray, owner: np.ndarray) -> tuple[Member, np.ndarray, np.ndarray]:
    """Distinct grams, and offsets of each one's owners."""
    order = np.lexsort((owner, gram))
    starts = run_starts(gram[order])
    return Member(gram[order][starts]), np.append(starts, len(gram)), owner[order]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word lists and where it ends in text."""
    idx = np.arange(1, len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        step = np.maximum(row[:-1] + np.where(text == word, 2, -1), row[1:] - 1)
        np.maximum(step, 0, out=step)
        row = np.concatenate([[0], np.maximum.accumulate(step + idx) - idx])
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def met(words: np.ndarray, doc: np.ndarray, n: int, size: int, seeds: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, word of the text) of every seed that a text holds, in order."""
    member, offset, owner = seeds
    grams, bounds = tx.shingles(words, doc, n, size)
    place, which = member.find(grams)
    holder = np.searchsorted(bounds, place, "right") - 1
    count = (offset[1:] - offset[:-1])[which]
    each = np.repeat(np.arange(len(place)), count)
    item = owner[np.repeat(offset[which] - (np.cumsum(count) - count), count) + np.arange(len(each))]
    text, word = holder[each], (place - bounds[holder])[each]
    order = np.lexsort((word, item, text))
    return text[order], item[order], word[order]


def matches(items: Items, seeds: dict[int, tuple], data: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple]:
    """(text, item, score, first byte, past last byte) of each copy's best alignment."""
    words, doc, start, end = hashed_words(data, at)
    n = len(at) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    best: dict[tuple[int, int], tuple] = {}
    for gram, index in seeds.items():
        text, item, word = met(words, doc, n, gram, index)
        if not len(text):
            continue
        size = np.array([len(w) for w in items.words])[item]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (word[1:] - word[:-1] > 2 * size[1:])
        cuts = np.append(np.flatnonzero(new), len(text))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            t, k, m = int(text[i]), int(item[i]), int(size[i])
            base = first[t]
            a = max(base, base + word[i] - 2 * m)
            b = min(first[t + 1], base + word[j - 1] + 2 * m + gram)
            score, stop = align(items.words[k], words[a:b])
            enough = score >= min(FLOOR, 2 * m)
            score = score / (2 * m)
            if enough and score >= threshold and score > best.get((t, k), (0,))[0]:
                _, back = align(items.words[k][::-1], words[a : a + stop][::-1])
                best[t, k] = (score, int(start[a + stop - back] - at[t]), int(end[a + stop - 1] - at[t]))
    return [(t, int(items.ids[k]), *x) for (t, k), x in best.items()]


def item_blocks(docs: DataFrame, items: DataFrame) -> Iterator[tuple[Items, dict[int, tuple]]]:
    """Items and their seeds, in blocks of at most about BLOCK bytes."""
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    load = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-load // BLOCK)
    for block in range(blocks):
        own = Items.of(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect())
        if own.words:
            yield own, own.seeds(*word_counts(docs, np.unique(np.concatenate(own.words))))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, first_byte, last_byte): a row for each document and
    item of which it holds a copy; the bytes are those of the best one."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, score double, first_byte long, last_byte long"
    found = spark.createDataFrame([], schema)
    for block in item_blocks(docs, items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for i, _, data, at in tx.slices(batch.column(1)):
                    rows = matches(*shared.value, data, at, threshold)
                    if rows:
                        t, *rest = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": ids.take(pa.array([i + x for x in t])), **{c: pa.array(v) for c, v in zip(("item_id", "score", "first_byte", "last_byte"), rest, strict=True)}}
                        )

        found = found.unionByName(docs.mapInArrow(run, schema))
    best = F.max(F.struct("score", (-F.col("first_byte")).alias("f"), "last_byte")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.f")).alias("first_byte"), "b.last_byte")


def uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows, with all their columns, that hold no copy of an item."""
    spark = prepare(docs.sparkSession)
    column, out = docs.columns.index("text"), docs
    for block in item_blocks(docs, items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, at in tx.slices(batch.column(column)):
                    keep = np.ones(j - i, bool)
                    keep[[x[0] for x in matches(*shared.value, data, at, threshold)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def word_counts(docs: DataFrame, words: np.ndarray) -> tuple[dict[int, int], int]:
    """Occurrences of the given words in the whole corpus, and its number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(Member(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = shared.value
        counts, total = np.zeros(len(member.values), np.int64), 0
        for batch in batches:
            for _, _, data, at in tx.slices(batch.column(0)):
                hashes, _, _, _ = hashed_words(data, at)
                total += len(hashes)
                counts += np.bincount(member.find(hashes)[1], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.append(some, -1)), "c": pa.array(np.append(counts[some], total))})

    rows = docs.select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()  # a row a word
    got = {r.k: r.c for r in rows}
    return {int(words[k]): c for k, c in got.items() if k >= 0}, got.get(-1, 0)


def op5_benchmark_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
