"""Phrase collocations (operator 13).

Every word of a piece begins a suffix of up to ``LONGEST`` words. A task merges its equal
suffixes and routes them by language and leading words: those of three words and more by
three, the first two words of each by both, and words by themselves, so that all
occurrences of a phrase meet in one bucket and a bucket gets at most one entry of a suffix
from each flush of a task. There pointers to the suffixes are sorted by multikey three-way
quicksort: each round splits all open segments at a pivot of the word at their depth; an
equal part is a phrase one word longer, its summed weight is the phrase's count, and a part
that weighs less than the least count is abandoned. So are, before the sort, suffixes that
weigh less with all that share a hash of their leading words. A bucket that gets more than ``HELD``
entries merges equal ones, so that it holds distinct suffixes, however often they come.

Words travel as places in a dictionary of their bytes, one for each flush and bucket, so
phrases are compared as they are, not by hash. The frequent phrases are a table; scores
join it with itself on the parts of each phrase.

Pieces end at ``[.,;:!?\\x0A-\\x0D]`` and at the end of a text; words are runs of other bytes
than space and tab, with A-Z lower-cased. Null and empty texts have no words, a null lang is
``und``. Repeated rows count each; an empty table and one without frequent phrases give no
rows; extra columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import prepare, scratch, splits, table
from .exchange import bucket_of, run_starts, squeeze, unsqueeze

U = np.uint64
LONGEST = 4
#: Words of a flush; entries of a bucket before equal ones are merged.
FLUSH, HELD = 1 << 20, 1 << 21
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS = ENDS.copy()
BREAKS[[0x20, 0x09]] = True


class Flush:
    """Words of some texts: hash, language and whether the next word is of the same piece."""

    def __init__(self) -> None:
        self.hashes, self.lang, self.joined, self.words, self.langs, self.n = [], [], [], {}, {}, 0

    def add(self, langs: list[str | None], data: np.ndarray, at: np.ndarray) -> None:
        data = tx.LOWER[data]
        hashes, doc, start, end = tx.word_hashes(data, at, BREAKS)
        ends = np.concatenate([[0], np.cumsum(ENDS[data])])
        joined = np.zeros(len(start), bool)
        joined[:-1] = (doc[1:] == doc[:-1]) & (ends[start[1:]] == ends[end[:-1]])
        own = np.array([self.langs.setdefault("und" if x is None else x, len(self.langs)) for x in langs], np.int64)
        code, some = pd.factorize(hashes)
        first = np.zeros(len(some), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        for h, s, e in zip(some.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            if h not in self.words:
                self.words[h] = data[s:e].tobytes()
        self.hashes.append(hashes)
        self.joined.append(joined)
        self.lang.append(own[doc])
        self.n += len(hashes)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[str]]:
        """Lead, words (0 where a piece has ended) and count of the distinct suffixes,
        hash to route by, words and languages. The lead is 3 * language + kind: 0 for
        words, 1 for two words, 2 for three and more."""
        word, known = pd.factorize(np.concatenate(self.hashes))
        joined, lang = np.concatenate(self.joined), np.concatenate(self.lang)
        n, word, base = len(word), word + 1, len(known) + 1
        after = np.where(joined, np.append(word[1:], 0), 0)
        pair, at = np.unique((lang * base + word) * base + after, return_inverse=True)
        lead, second = pair // base, pair % base
        count = np.bincount(at)
        # A suffix of three or more: its first two words, and what follows two words later.
        long = np.flatnonzero(joined[:-1] & joined[1:]) if n > 1 else np.zeros(0, np.int64)
        both, times = np.unique(at[long] * len(pair) + at[long + 2], return_counts=True)
        x, y = both // len(pair), both % len(pair)
        single = run_starts(lead)
        zero = np.zeros(len(pair), np.int64)
        two = second > 0
        parts = [  # lead, four words, count
            (lead[single] // base * 3, lead[single] % base, zero[single], zero[single], zero[single], np.add.reduceat(count, single)),
            (lead[two] // base * 3 + 1, lead[two] % base, second[two], zero[two], zero[two], count[two]),
            (lead[x] // base * 3 + 2, lead[x] % base, second[x], lead[y] % base, second[y], times),
        ]
        kind, *words, count = (np.concatenate(c) for c in zip(*parts, strict=True))
        names = sorted(self.langs, key=self.langs.get)
        code = np.array([zlib.crc32(x.encode()) for x in names], U)
        hashes = np.concatenate([[U(0)], known])
        route = tx.mix(code[kind // 3] + (kind % 3).astype(U))
        for w in words[:3]:
            route = tx.mix(route * tx.BASE + hashes[w])
        texts = [b""] + [self.words[h] for h in known.tolist()]
        return np.stack([kind, *words, count], axis=1), route, texts, names

    def rows(self, buckets: int) -> Iterator[tuple[int, bytes, bytes, str]]:
        """(bucket, entries, words, languages)."""
        if not self.n:
            return
        entries, route, texts, names = self.entries()
        bucket = bucket_of(route, buckets)
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        cuts = np.append(run_starts(bucket), len(bucket))
        place = np.zeros(len(texts), np.uint32)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own = entries[i:j].astype(np.uint32)
            used = pd.unique(own[:, 1:5].ravel())
            used = np.sort(used[used > 0])
            place[used] = np.arange(1, len(used) + 1)
            own[:, 1:5] = place[own[:, 1:5]]
            planes = own.view(np.uint8).reshape(-1, 24).T
            words = b" ".join([texts[w] for w in used.tolist()])
            yield int(bucket[i]), squeeze(planes.tobytes()), squeeze(words), json.dumps(names)


def send(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed suffixes of the texts (lang, text)."""

    most = FLUSH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = Flush()

        def out() -> Iterator[pa.RecordBatch]:
            for row in flush.rows(buckets):
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:3]), pa.array(row[3:])], ["bucket", "entries", "words", "langs"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, j, data, at in tx.slices(batch.column(1)):
                flush.add(langs[i:j], data, at)
                if flush.n >= most:
                    yield from out()
                    flush = Flush()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "bucket int, entries binary, words binary, langs string")


def merged(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` and the summed weights of each."""
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    first = run_starts(*keys.T)
    return keys[first], np.add.reduceat(weight[order], first)


def able(keys: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
    """Rows that can hold a phrase of ``least`` occurrences: those that weigh as much with
    all rows that share the hash of what they were routed by, the first three words at most."""
    low = tx.mix(tx.mix(keys[:, 0].astype(U)) * tx.BASE + keys[:, 1].astype(U))
    low = tx.mix(low * tx.BASE + keys[:, 2].astype(U)) >> U(64 - max(8, len(keys).bit_length()))
    return np.flatnonzero(np.bincount(low.astype(np.int64), weight)[low.astype(np.int64)] >= least)


def quicksort(keys: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pointer, depth, weight) of all prefixes of ``keys`` rows that weigh ``least`` or
    more, by multikey three-way quicksort of pointers to the rows. All open segments are
    split in one round. A key of 0 ends a row; nothing longer is looked for behind it."""
    pointer = np.arange(len(keys))
    size, depth = np.array([len(keys)]), np.array([0])
    while len(pointer):
        start = np.cumsum(size) - size
        key = keys[pointer, np.repeat(depth, size)]
        a, b, c = key[start], key[start + size // 2], key[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))  # the middle one
        middle = np.repeat(pivot, size)
        less, more = key < middle, key > middle
        n_less, n_more = np.add.reduceat(less, start, dtype=np.int64), np.add.reduceat(more, start, dtype=np.int64)
        n_equal = size - n_less - n_more
        moved = np.empty_like(pointer)
        for part, n_part, begin in ((less, n_less, start), (~(less | more), n_equal, start + n_less), (more, n_more, start + n_less + n_equal)):
            # Pointers of the part, in order of their segments, go behind where each segment's part begins.
            before = np.cumsum(n_part) - n_part
            moved[np.arange(n_part.sum()) + np.repeat(begin - before, n_part)] = pointer[part]
        size = np.stack([n_less, n_equal, n_more], axis=1).ravel()
        depth = np.stack([depth, depth + 1, depth], axis=1).ravel()
        upto = np.concatenate([[0], np.cumsum(weight[moved])])
        end = np.cumsum(size)
        heavy = upto[end] - upto[end - size]
        equal = np.arange(len(size)) % 3 == 1
        word = np.repeat(pivot, 3) > 0
        seen = equal & word & (heavy >= least)
        yield moved[(end - size)[seen]], depth[seen], heavy[seen]
        stay = (size > 0) & (heavy >= least) & (~equal | word & (depth < keys.shape[1]))
        pointer = moved[np.repeat(stay, size)]
        size, depth = size[stay], depth[stay]


def count(sent: DataFrame, buckets: int, least: int) -> DataFrame:
    """(lang, phrase, words, a) of phrases with ``least`` occurrences or more, and
    rows without a phrase that add up to the words of each language."""

    most = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, langs = {b"": 0}, {}
        keys, weights, held, limit = [], [], 0, most
        for batch in batches:
            for packed, dictionary, names in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                data = np.frombuffer(unsqueeze(packed), np.uint8)
                own = np.ascontiguousarray(data.reshape(24, -1).T).view(np.uint32).astype(np.int64)
                place = np.array([0] + [ids.setdefault(w, len(ids)) for w in unsqueeze(dictionary).split(b" ")])
                lang = np.array([langs.setdefault(x, len(langs)) for x in json.loads(names)])
                # Kind and first word are one key, as no phrase is told by its kind alone.
                lead = lang[own[:, 0] // 3] * 3 + own[:, 0] % 3
                keys.append(np.column_stack([lead << 40 | place[own[:, 1]], *(place[own[:, k]] for k in (2, 3, 4))]))
                weights.append(own[:, 5])
                held += len(own)
            if held > limit:
                one, weight = merged(np.concatenate(keys), np.concatenate(weights))
                keys, weights, held = [one], [weight], len(one)
                limit = most + 2 * held
        if not held:
            return
        rows, weight = np.concatenate(keys), np.concatenate(weights)
        del keys, weights
        words, names = list(ids), list(langs)
        lead = rows[:, 0] >> 40
        single = lead % 3 == 0
        total = np.bincount(lead[single] // 3, weight[single], minlength=len(names)).astype(np.int64) if single.any() else np.zeros(len(names), np.int64)
        yield batch_of(names, [None] * len(names), [0] * len(names), total.tolist())
        some = able(rows, weight, least)
        rows, weight, lead = rows[some], weight[some], lead[some]
        for at, depth, heavy in quicksort(rows, weight, least):
            kind = lead[at] % 3
            good = (depth == kind + 1) | (kind == 2) & (depth == 4)
            at, depth, heavy = at[good], depth[good], heavy[good]
            if len(at):
                first = rows[at, 0] & ((1 << 40) - 1)
                parts = np.column_stack([first, rows[at, 1:]]).tolist()
                text = [b" ".join([words[w] for w in p[:d]]).decode() for p, d in zip(parts, depth.tolist(), strict=True)]
                yield batch_of([names[k] for k in (lead[at] // 3).tolist()], text, depth.tolist(), heavy.tolist())

    return sent.repartitionById(buckets, "bucket").mapInArrow(run, "lang string, phrase string, words int, a long")


def batch_of(lang: list, phrase: list, words: list, a: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.string()), "words": pa.array(words, pa.int32()), "a": pa.array(a, pa.int64())})


def frequent(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Kept table (lang, phrase, words, a) of frequent phrases, and (lang, n)."""
    spark = prepare(docs.sparkSession)
    buckets = 4 * splits(docs)
    path = scratch(spark, "phrases")
    count(send(docs, buckets), buckets, least).write.parquet(path)
    found = spark.read.schema("lang string, phrase string, words int, a long").parquet(path)
    return found.where("words > 0"), found.where("words = 0").groupBy("lang").agg(F.sum("a").alias("n"))


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, n: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two to
    four words. A phrase that a longer one holds ``percent`` of the time is left out."""
    found, totals = frequent(docs, least)
    whole = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice(whole, start, size), " ")
    pieces = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: joined(i, k))))
    inside = (
        found.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(pieces)).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    stay = found.where("words > 1").join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * percent)).drop("longer")
    cuts = stay.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({"head": joined(F.lit(1), F.col("k")), "tail": joined(F.col("k") + 1, F.col("words"))})
    part = lambda key, name: found.select("lang", F.col("phrase").alias(key), F.col("a").alias(name))
    sides = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    scored = sides.withColumn("score", F.expr("CAST(a AS DECIMAL(20,0)) * 2000000BD DIV (CAST(l AS DECIMAL(20,0)) + r)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    flat = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = flat.withColumn("rank", rank).where(F.col("rank") <= n)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS at FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k
), counts AS (SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') AS phrase
    FROM counts, (SELECT unnest([2, 3]) AS k), (SELECT unnest([1, 2, 3]) AS i) WHERE k < words AND i + k - 1 <= words)
  GROUP BY lang, phrase
), stay AS (SELECT c.* FROM counts c LEFT JOIN inside i USING (lang, phrase) WHERE words > 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)),
cuts AS (
  SELECT *, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:words], ' ') AS tail
  FROM stay, (SELECT unnest([1, 2, 3]) AS k) WHERE k < words
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, h.a AS l, t.a AS r, CAST(2000000::HUGEINT * c.a // (h.a + t.a) AS BIGINT) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = head JOIN counts t ON t.lang = c.lang AND t.phrase = tail
), lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
