"""Removal of repeated runs of sentences (operator 4).

A sentence ends at a line break, or at white space after ``.``, ``!`` or ``?``. Two
sentences are equal if their words are (A-Z lower-cased, white space aside). Every
run of ``run`` neighbouring sentences with ``least`` words or more is hashed. With
``grow``, so is every longer run that has enough words, but not without its first or
not without its last sentence; then any repeated passage of ``run`` sentences and
``least`` words is covered by runs, however short its sentences are. A text that has no
such run (one sentence, or too few words) is then hashed as a whole, and meets only
texts that are equal as a whole. Over all documents the first of equal runs, by
(doc_id, place), stays; sentences that any other run covers go. Runs are judged on the
input, and may overlap. A task keeps the first of its equal runs and marks the others at
once, so of a run that very many documents share each task sends one; these are packed
and exchanged by hash (``exchange``).

Null and empty texts have no sentences and stay as they are. Rows that share a
doc_id are told apart by their texts; rows equal in both are one document and get
equal results. Rows with null doc_ids come behind all others, beside the largest id
there can be. Rows are dealt over tasks by a hash of id and text, so neither rows without
an id nor rows of one id meet in one task, but for those that are equal in both. An empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import prepare, splits, table
from .exchange import run_starts, scatter, unpack_all
from .suffix_dedup import by_document, frame

U = np.uint64
FLUSH = 500_000
LAST = np.iinfo(np.int64).max
STOP = np.zeros(256, bool)
STOP[[0x21, 0x2E, 0x3F]] = True
#: run, document, row mark, place, sentences
ENTRY = (U, np.int64, np.int64, np.int32, np.int32)
#: row mark, document, place, sentences
CUT = (U, np.int64, np.int64, np.int32, np.int32)


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every sentence: first byte, its text, hash, and number of words. Sentences
    tile the text: each runs to the next one's first byte."""
    hashes, doc, start, end = tx.word_hashes(tx.LOWER[data], at)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U), none
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    opens = np.ones(len(hashes), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | STOP[data[end[:-1] - 1]] | (breaks[start[1:]] > breaks[end[:-1]])
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(hashes)))
    place = np.arange(len(hashes)) - np.repeat(first, size)
    total = np.add.reduceat(tx.mix(hashes + tx.mix(place.astype(U) + U(1))), first)
    head = np.where(doc[first] != np.append(-1, doc[first][:-1]), at[doc[first]], start[first])
    return head, doc[first], tx.mix(total + size.astype(U)), size


def runs(owner: np.ndarray, hashes: np.ndarray, size: np.ndarray, run: int, least: int, grow: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and number of sentences of every run inside a text."""
    n = len(owner)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.concatenate([[0], np.cumsum(size)])
    begin, end = np.searchsorted(owner, owner), np.searchsorted(owner, owner, "right")
    # The shortest run from each sentence on, then the shortest up to each sentence.
    a = np.arange(n)
    b = np.maximum(a + run, np.searchsorted(words, words[:-1] + least))
    inside = b <= end
    d = a + 1
    c = np.minimum(d - run, np.searchsorted(words, words[1:] - least, "right") - 1)
    other = c >= begin
    other[other] = b[c[other]] != d[other]
    # Texts without a run: their first sentences.
    whole = (a == begin) & ((end - begin < run) | (words[end] - words[begin] < least))
    if not grow:
        inside &= b - a == run
        other[:], whole[:] = False, False
    first = np.concatenate([a[inside], c[other], a[whole]])
    past = np.concatenate([b[inside], d[other], end[whole]])
    prefix = np.zeros(n + 1, U)
    np.cumsum(hashes * tx.powers(n), out=prefix[1:])
    unpowers = tx.powers(n, tx.UNBASE)
    return tx.mix((prefix[past] - prefix[first]) * unpowers[first] + (past - first).astype(U)), first, past - first


def dedup_sentences(docs: DataFrame, run: int = 2, least: int = 10, grow: bool = False) -> DataFrame:
    """doc_id, n_sentences, n_removed and text (what is kept) of every row."""
    prepare(docs.sparkSession)
    own = F.col("doc_id").cast("long")
    docs = docs.select(F.coalesce(own, F.lit(LAST)).alias("doc_id"), "text", own.isNull().alias("none"), F.xxhash64(own, "text").alias("mark"))
    buckets = 8 * splits(docs) | 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids, mark = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for i, _, data, at in tx.slices(batch.column(1)):
                _, owner, hashes, size = split(data, at)
                key, first, length = runs(owner, hashes, size, run, least, grow)
                text = owner[first]
                place = (first - np.searchsorted(owner, text)).astype(np.int32)
                held.append((key, ids[i:][text], mark[i:][text], place, length.astype(np.int32)))
                count += len(key)
                if count >= FLUSH:
                    yield send(held)
                    held, count = [], 0
        if count:
            yield send(held)

    def send(held: list[tuple]) -> pa.RecordBatch:
        first, cuts = apart([np.concatenate(x) for x in zip(*held, strict=True)])
        rows = [(b, p, None) for b, p in scatter(first, buckets)] + [(b, None, p) for b, p in cuts]
        kinds = (("bucket", pa.int32()), ("entries", pa.binary()), ("cuts", pa.binary()))
        return pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    def apart(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple[int, bytes]]]:
        """Of entries the first of each run, and the others as cuts by their rows' buckets."""
        key, doc, mark, place, length = columns
        order = np.lexsort((place, mark, doc, key))
        order = order[run_starts(*(c[order] for c in (key, doc, mark, place)))]
        again = np.ones(len(order), bool)
        again[run_starts(key[order])] = False
        gone, stay = order[again], order[~again]
        cuts = list(by_document([mark[gone], doc[gone], place[gone], length[gone]], buckets)) if len(gone) else []
        return [c[stay] for c in columns], cuts

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        _, cuts = apart(unpack_all([x for x in part["entries"] if x is not None], ENTRY))
        return frame(cuts + [(part["bucket"].iloc[0], x) for x in part["cuts"] if x is not None], ["bucket", "cuts"])

    def apply(texts: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        ids, none, mark, cuts = texts["doc_id"].to_numpy(np.int64), texts["none"].to_numpy(bool), texts["mark"].to_numpy(np.int64), {}
        data, at = tx.buffers(pa.array(texts["text"], pa.string()))
        _, own, doc, place, length = unpack_all(list(part["cuts"]), CUT)
        for d, m, p, k in zip(doc.tolist(), own.tolist(), place.tolist(), length.tolist(), strict=True):
            cuts.setdefault((d, m), []).append((p, k))
        head, owner, _, _ = split(data, at)
        first, out = np.searchsorted(owner, np.arange(len(texts) + 1)), []
        for i, (d, text) in enumerate(zip(ids.tolist(), texts["text"], strict=True)):
            begin, n = head[first[i] : first[i + 1]], int(first[i + 1] - first[i])
            gone = np.zeros(n, bool)
            for p, k in cuts.get((d, int(mark[i])), []):
                gone[p : p + k] = True
            bounds = np.append(begin, at[i + 1])
            kept = text if not gone.any() else b"".join(data[a:b].tobytes() for a, b, g in zip(bounds[:-1], bounds[1:], gone, strict=True) if not g).decode()
            out.append((d, bool(none[i]), n, int(gone.sum()), kept))
        return frame(out, ["doc_id", "none", "n_sentences", "n_removed", "text"])

    cuts = docs.mapInArrow(gather, "bucket int, entries binary, cuts binary").groupBy("bucket").applyInPandas(decide, "bucket int, cuts binary")
    return (
        docs.withColumn("bucket", F.pmod("mark", F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .cogroup(cuts.groupBy("bucket"))
        .applyInPandas(apply, "doc_id long, none boolean, n_sentences long, n_removed long, text string")
        .select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_sentences", "n_removed", "text")
    )


def op4_substring_dedup(spark, sf_dir):
    return dedup_sentences(table(spark, sf_dir, "documents"), grow=True)


#: Sentences as tiles of the text, and every run as the string of its words.
SQL = r"""
WITH tiles AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?:\A[\x20\x09-\x0D]+)?'
    || '(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09\x0B-\x0D]+)*'
    || '(?:[^\x20\x09-\x0D]*[.!?](?:[\x20\x09-\x0D]+|\z)'
    || '|[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?](?:[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*|[\x20\x09-\x0D]*\z))') AS tiles
  FROM documents
), texts AS (
  SELECT doc_id, text, tiles, list_transform(tiles, lambda x: trim(regexp_replace(
    translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS keys
  FROM tiles
), sentences AS (
  SELECT doc_id, p, tiles[p] AS tile, length(keys[p]) - length(replace(keys[p], ' ', '')) + 1 AS size
  FROM (SELECT doc_id, tiles, keys, unnest(range(1, len(tiles) + 1)) AS p FROM texts)
), counted AS (
  SELECT doc_id, p, sum(size) OVER (PARTITION BY doc_id ORDER BY p) - size AS before, sum(size) OVER (PARTITION BY doc_id ORDER BY p) AS upto, size
  FROM sentences
), enough AS (
  SELECT a.doc_id, a.p AS a, b.p AS b,
    b.p - a.p > 1 AND b.before - a.before >= 10 AS without_last, b.p - a.p > 1 AND b.upto - a.upto >= 10 AS without_first
  FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p + 1 AND a.p + 10
  WHERE b.upto - a.before >= 10
), found AS (SELECT doc_id, a, b FROM enough WHERE NOT (without_last AND without_first)),
runs AS (
  SELECT doc_id, a, b FROM found
  UNION ALL SELECT doc_id, 1, len(tiles) FROM texts WHERE len(tiles) > 0 AND doc_id NOT IN (SELECT doc_id FROM found)
), named AS (SELECT doc_id, a, b, array_to_string(keys[a:b], chr(10)) AS words FROM runs JOIN texts USING (doc_id)),
later AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY words ORDER BY doc_id, a) AS k FROM named),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS p FROM later WHERE k > 1),
kept AS (
  SELECT s.doc_id, count(*) AS n_sentences, count(g.p) AS n_removed, coalesce(string_agg(s.tile, '' ORDER BY s.p) FILTER (WHERE g.p IS NULL), '') AS text
  FROM sentences s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.p = g.p GROUP BY s.doc_id
)
SELECT t.doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN coalesce(n_removed, 0) = 0 THEN t.text ELSE k.text END AS text
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
