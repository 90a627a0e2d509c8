"""Periodic runs of words (operator 12).

A run is a stretch of consecutive words with smallest period q, of ``LEAST`` words and
``2 * q`` or more, that no neighbouring word extends. Words are read once, in order. A
word that equals the word ``lag`` places before it lengthens the match of that lag;
the table of active lags is sparse, and a match that ends emits its run at once if it
is long enough. Where several lags of one stretch are emitted, the smallest is its period.

A lag becomes active at a word only if its match can become long enough: as many words
as the run needs must follow equally, which hashes of word sequences tell beforehand.
They are hashed at doubling lengths: a match of a lag between g and 2g needs g equal
words, which stand at few places so near to each other unless they are periodic
themselves. Then the lag is a multiple of an active one from the same first word, which
makes it redundant. So texts of one repeated word, or of two, take about n log n steps
and no pair of occurrences in between is looked at; words themselves are compared as bytes.

Null, empty and wordless texts have no run. A null id is kept; repeated rows get equal
results; an empty table gives none; extra columns are not read. Texts are read whole, one
at a time if they are long.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import prepare, table

U = np.uint64
#: Words of the shortest run; equal words that its match needs at any lag (12 - q or q of them).
LEAST, SEED = 12, 6

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Places = Callable[[int | None, int], np.ndarray | None]


def openings(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) of every match that can make a run, at the first word that the match
    holds; ``at`` are the places where documents begin, and the end."""
    size = np.diff(at)
    end, first = np.repeat(at[1:], size), np.zeros(len(hashes) + 1, bool)
    first[at] = True
    before = np.concatenate([[U(0)], hashes[:-1]]) if len(hashes) else hashes
    prefix = np.concatenate([[U(0)], np.cumsum(hashes * tx.powers(len(hashes)))])
    doc = tx.mix(np.repeat(np.arange(len(size), dtype=U), size))
    found, tried = [], np.arange(len(hashes))
    low, gram = 1, SEED
    while len(tried):
        high = LEAST if low == 1 else 2 * low
        tried = tried[tried + gram <= end[tried]]
        key = tx.span_hash(prefix, tried, tried + gram) ^ doc[tried]
        order = np.argsort(key, kind="stable")
        place, key = tried[order], key[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        again = same.copy()
        again[:-1] |= same[1:]
        place, same = place[again], same[again]  # sequences that stand in their text twice
        found.append(pairs(place, same, first[place], before[place], low, high))
        tried = np.sort(place)
        low, gram = high, high
    lag = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    word = np.concatenate([f[0] for f in found]) if found else lag
    order = np.lexsort((lag, word))
    return word[order], lag[order]


def pairs(place: np.ndarray, same: np.ndarray, first: np.ndarray, before: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of two places of a group with lags from ``low`` to below ``high`` that
    have different words before them. Groups are neighbours with ``same``. Places with the
    same word before them are jumped over as a block."""
    n = np.arange(len(place))
    group = np.maximum.accumulate(np.where(same, 0, n))
    turn = ~same
    turn[1:] |= (before[1:] != before[:-1]) | first[1:] | first[:-1]
    block = np.maximum.accumulate(np.where(turn, n, 0))
    words, lags = [], []
    own, other = n, block - 1
    while True:
        near = other >= group[own]
        own, other = own[near], other[near]
        near = place[own] - place[other] < high
        own, other = own[near], other[near]
        if not len(own):
            break
        alike = (before[own] == before[other]) & ~first[own] & ~first[other]
        lag = place[own] - place[other]
        good = ~alike & (lag >= low)
        words.append(place[own[good]])
        lags.append(lag[good])
        other = np.where(alike, block[other] - 1, other - 1)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(lags)


def follow(words: list[bytes], opened: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, in this order."""
    period: dict[tuple[int, int], int] = {}
    active: dict[int, int] = {}  # lag: first word of its match
    n, k = len(words), 0

    def emit(lag: int, end: int) -> None:
        start = active.pop(lag) - lag
        if end - start >= max(LEAST, 2 * lag):
            period[start, end] = min(lag, period.get((start, end), lag))

    i = 0
    while True:
        if not active:
            if k == len(opened):
                break
            i = opened[k][0]
        elif i < n:
            word = words[i]
            for lag in [lag for lag in active if word != words[i - lag]]:
                emit(lag, i)
        else:
            for lag in list(active):
                emit(lag, n)
            break
        while k < len(opened) and opened[k][0] == i:
            lag = opened[k][1]
            if words[i] == words[i - lag] and not any(lag % q == 0 and begun - q == i - lag for q, begun in active.items()):
                active[lag] = i
            k += 1
        i += 1
    return sorted((s, e - s, q) for (s, e), q in period.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that stay: those in no run after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.flatnonzero(np.cumsum(gone[:n]) == 0)


def spaced(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts with one space between words and none around them, and their offsets."""
    keep = ~tx.SPACES[data]
    between = end[:-1][doc[1:] == doc[:-1]]
    keep[between] = True
    out = data.copy()
    out[between] = 32
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def slice_runs(ids: list[int | None], data: np.ndarray, at: np.ndarray, places: Places | None) -> pa.RecordBatch:
    """Results of the texts of one slice."""
    hashes, doc, start, end = tx.word_hashes(data, at)
    flat, flat_at = spaced(data, at, start, end, doc)
    bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
    order = np.arange(len(hashes))
    other = set()
    for d, who in enumerate(ids):
        own = places(who, int(bounds[d + 1] - bounds[d])) if places else None
        if own is not None:
            order[bounds[d] : bounds[d + 1]] = bounds[d] + own
            other.add(d)
    hashes, start, end = hashes[order], start[order], end[order]
    at_word, lag = openings(hashes, bounds)
    cuts = np.searchsorted(at_word, bounds)
    runs, texts = [], []
    for d in range(len(ids)):
        a, b = bounds[d : d + 2]
        some = slice(*cuts[d : d + 2])
        found, words = [], []
        if some.start < some.stop or d in other:
            words = [data[s:e].tobytes() for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
            found = follow(words, list(zip((at_word[some] - a).tolist(), lag[some].tolist(), strict=True)))
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
        if found or d in other:
            texts.append(b" ".join([words[i] for i in kept_words(len(words), found).tolist()]))
        else:
            texts.append(flat[flat_at[d] : flat_at[d + 1]].tobytes())
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(np.diff(bounds)),
            "runs": pa.array(runs, pa.list_(RUN)),
            "collapsed": pa.array(texts, pa.large_binary()).cast(pa.large_string()),
        }
    )


def find_runs(docs: DataFrame, places: Places | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in this order) and the collapsed text
    of every document. ``places`` may give the order in which the n words of a document
    are read: an array of n word numbers, or None to read them as they stand."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, at in tx.slices(batch.column(1)):
                yield slice_runs(ids[i:j], data, at, places)

    kind = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document (by checksum of its id) repeats a stretch of its words to its end."""
    h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark, sf_dir):
    found = find_runs(table(spark, sf_dir, "documents"), planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: CRC-32 by its defining table (reflected polynomial 0xEDB88320), folded over the id's digits.
#: Runs: pairs of equal words by lag, stretches of neighbouring pairs, the smallest lag of each stretch.
SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM (SELECT CAST(unnest(range(256)) AS UBIGINT) AS i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    CAST(xor(4294967295::UBIGINT, list_reduce(
      list_concat([4294967295::UBIGINT],
        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
      lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) + 1 AS BIGINT)]))) AS BIGINT) AS h
  FROM documents, crc
), bent AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM hashed
), placed AS (
  SELECT doc_id, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM bent)
), grams AS (
  SELECT *, hash(word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o) AS six
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), lags AS (SELECT DISTINCT b.doc_id, b.i - a.i AS lag FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.six = b.six AND a.i < b.i),
equal AS (
  SELECT l.doc_id, l.lag, b.i FROM lags l JOIN placed b ON b.doc_id = l.doc_id JOIN placed a ON a.doc_id = l.doc_id AND a.i = b.i - l.lag AND a.word = b.word
), stretches AS (
  SELECT doc_id, lag, min(i) - lag AS start, max(i) + 1 AS stop
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM equal) GROUP BY doc_id, lag, island
), runs AS (
  SELECT doc_id, start, stop - start AS length, min(lag) AS period FROM stretches WHERE stop - start >= greatest(12, 2 * lag) GROUP BY doc_id, start, stop
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS r FROM runs) WHERE r = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
