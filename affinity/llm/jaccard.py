"""Exact n-gram Jaccard join by parity sketches (operator 2).

A document's set of word shingles is XOR-hashed into a bit sketch: every shingle
flips one bit, so two sketches differ in at most as many bits as the sets differ
in elements. Sets are joined inside geometric size bands. A pair in reach of the
threshold in a band differs in at most D elements. Of a sketch cut into more than
D / 2 triples of pieces, at least one triple differs in one piece or none, and so
agrees in two: pairs of pieces in a triple are the join keys. A piece counts as the
XOR of its set bits' codes, in which flips cancel like in the sketch. Pairs with one
bit or none meet by chance; bands have some spare triples, and only a set that has
such pairs in more triples than that sends them, so no pair of sets is lost.

Holders of an equal key form a group. Groups of the same holders are one, equal
sets are one holder, and in each group the holders' whole sketches, which bound the
difference from below, rule out chance meetings; a forest over the rest gives
candidate clusters. In these, sketches again pick the pairs that are verified on
the sets, until every two members are linked, connected or refuted. No step emits
all pairs of a group; large groups and clusters are cut into blocks, and each pair
of blocks is a task. Links are then joined to components.

Words: A-Z is lower-cased, words are runs of bytes other than 0x20 and 0x09-0x0D.
Fewer words than the shingle size: the whole sequence is the one shingle. Null,
empty and wordless texts have empty sets and link with nothing. Rows that share a
doc_id are separate sets reported under that id. Rows with a null doc_id link with
nothing. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import discard, prepare, release, scratch, splits, table
from .components import components
from .exchange import forest, run_starts, scatter, unpack_all

U = np.uint64
#: Entries a task gathers before it sends them.
FLUSH = 1_000_000
#: Sketch bits a piece covers. Pieces are never laid out in full, so wide ones cost nothing,
#: and two of few set bits hardly ever agree by chance, however many documents there are.
WIDTH = 1 << 20
#: Holders in a block of a group.
BLOCK_HOLDERS = 3000
#: Members and shingles of a block of a candidate cluster.
BLOCK_ROWS, BLOCK_SHINGLES = 1500, 4_000_000


@lru_cache(maxsize=8)
def bands(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First size, greatest difference D of a pair, triples of pieces, and spare triples
    of each band, beyond sizes ``upto``."""
    first = [1]
    while first[-1] <= upto:
        first.append(max(first[-1] + 1, -(-first[-1] * 100 // percent)))
    first.append(max(first[-1] + 1, -(-first[-1] * 100 // percent)))
    most = np.array(first[1:]) - 1
    differ = 2 * most * (100 - percent) // (100 + percent)
    spare = np.where(differ > 0, 1 + differ // 12, 0)
    return np.array(first[:-1]), differ, differ // 2 + 1 + spare, spare


def band_limit(n: int) -> int:
    return 1 << max(12, int(n).bit_length())


def sets_of(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, and offsets by document."""
    hashes, doc, _, _ = tx.word_hashes(tx.LOWER[data], at)
    made, bounds = tx.shingles(hashes, doc, len(at) - 1, size)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        made[i:j].sort()
    keep = np.zeros(len(made), bool)
    keep[run_starts(made, owner)] = True
    return made[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(at) - 1))])


def piece_keys(sets: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys and the document of each."""
    n = np.diff(bounds)
    first, differ, triples, spare = bands(percent, band_limit(n.max(initial=1)))
    own = np.searchsorted(first, n, "right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    keys, docs = [], []
    for up in (0, 1):
        band = own + up
        count = np.where(n > 0, triples[band], 0)
        offset = np.concatenate([[0], np.cumsum(count)])
        holder = np.repeat(np.arange(len(n)), count)
        base = (3 * WIDTH * offset).astype(U)
        place = tx.mix(sets + U(0x51ED2701)) % (count[owner] * 3 * WIDTH).astype(U) + base[owner]
        place.sort()
        starts = run_starts(place)
        bits = place[starts[np.diff(np.append(starts, len(place))) & 1 == 1]]
        piece = (bits // U(WIDTH)).astype(np.int64)
        code = tx.mix((bits - base[holder[piece // 3]] + U(1)) * tx.BASE)
        value, size = np.zeros(3 * offset[-1], U), np.bincount(piece, minlength=3 * offset[-1])
        firsts = run_starts(piece)
        if len(firsts):
            value[piece[firsts]] = np.bitwise_xor.reduceat(code, firsts)
        value, size = tx.mix(value).reshape(-1, 3), size.reshape(-1, 3)
        tag = tx.mix((band[holder].astype(U) << U(40) | (np.arange(offset[-1]) - offset[holder]).astype(U)) * tx.BASE + U(7))
        key = np.stack([tx.mix(value[:, i] + tx.mix(value[:, j] + tag + U(i + j))) for i, j in ((0, 1), (0, 2), (1, 2))], axis=1)
        # A pair of one bit or none tells little and is met by chance.
        weak = np.stack([size[:, i] + size[:, j] <= 1 for i, j in ((0, 1), (0, 2), (1, 2))], axis=1) & (spare[band] > 0)[holder, None]
        many = np.bincount(holder[weak.any(axis=1)], minlength=len(n)) > spare[band]
        sends = ~weak | many[holder, None]
        # Without room for a difference the whole set is the only key.
        same = (differ[band] == 0)[holder]
        key[same, 0] = tx.mix(value[same].sum(axis=1, dtype=U) + tag[same])
        sends[same] = [True, False, False]
        keys.append(key[sends])
        docs.append(np.repeat(holder, 3).reshape(-1, 3)[sends])
    return np.concatenate(keys), np.concatenate(docs)


def prints(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(tx.mix(sets + U(s)), dtype=U)]) for s in (1, 0x7F4A7C15)]
    return tuple((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)


def sketch_bits(n: int, percent: int) -> int:
    """Sketch size for a set of n: a power of two, 4 bits and more for every
    element in which two linked sets of that size may differ."""
    return max(64, 1 << int(8 * n * (100 - percent) // (100 + percent)).bit_length())


def sketch(elements: np.ndarray, bits: int) -> np.ndarray:
    """Bit k is the parity of the elements that hash to k."""
    odd = (np.bincount((tx.mix(elements + U(0xA5A5)) % U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U)


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches at their smallest size: halves of a sketch XOR to that of half its size."""
    least = min(map(len, sketches))
    out = np.zeros((len(sketches), least), U)
    for row, s in zip(out, sketches, strict=True):
        row[:] = np.bitwise_xor.reduce(s.reshape(-1, least), axis=0)
    return out


def fingerprints(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, print and sketch of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tx.slices(batch.column(1)):
                sets, bounds = sets_of(data, at, size)
                f, g = prints(sets, bounds)
                n = np.diff(bounds)
                bits = [sketch(sets[a:b], sketch_bits(b - a, percent)).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0).slice(i, j - i), "n_shingles": n, "f": f, "g": g, "sketch": pa.array(bits, pa.binary())}
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, f long, g long, sketch binary")


def shared_keys(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(gid, doc, holders): the holders of every key that several documents have;
    gid names the set of holders."""
    buckets = 8 * splits(docs)

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, keys))
        parts = list(scatter([keys[order], ids[order]], buckets))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([p[0] for p in parts], pa.int32()), "entries": pa.array([p[1] for p in parts], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, at in tx.slices(batch.column(1)):
                sets, bounds = sets_of(data, at, size)
                # Of equal sets in this task one sends keys; the others share its print.
                fresh = np.zeros(j - i, bool)
                for k, x in enumerate(zip(*(p.tolist() for p in prints(sets, bounds)), strict=True)):
                    fresh[k] = x not in seen
                    seen.add(x)
                keys, doc = piece_keys(sets, bounds, percent)
                keys, doc = keys[fresh[doc]], doc[fresh[doc]]
                held.append((keys, own[i:][doc]))
                count += len(keys)
                if count >= FLUSH:
                    yield from send(held)
                    held, count, seen = [], 0, set()
        if count:
            yield from send(held)

    def join(part: pd.DataFrame) -> pd.DataFrame:
        key, doc = unpack_all(list(part["entries"]), (U, np.int64))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        one = run_starts(key, doc)
        key, doc = key[one], doc[one]
        starts = run_starts(key)
        count = np.diff(np.append(starts, len(key)))
        starts, count = starts[count > 1], count[count > 1]
        total = np.concatenate([np.zeros(1, U), np.cumsum(tx.mix(doc.view(U) * tx.BASE + U(3)), dtype=U)])
        gid = tx.mix(total[starts + count] - total[starts] + count.astype(U)).view(np.int64)
        gid, pick = np.unique(gid, return_index=True)
        starts, count = starts[pick], count[pick]
        each = np.repeat(np.arange(len(gid)), count)
        place = starts[each] + np.arange(len(each)) - (np.cumsum(count) - count)[each]
        return pd.DataFrame({"gid": gid[each], "doc": doc[place], "holders": count[each]})

    sent = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, "bucket int, entries binary")
    return sent.groupBy("bucket").applyInPandas(join, "gid long, doc long, holders long").distinct()


def in_reach(n: np.ndarray, own: int, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and a lower bound of the difference allow a link."""
    return (n * 100 >= own * percent) & (n * percent <= own * 100) & (differ * (100 + percent) <= (n + own) * (100 - percent))


def likely_links(sketches: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest over the pairs that whole sketches don't rule out."""
    root, links = np.arange(len(n)), []
    within = bool((left & right).any())
    for a in np.flatnonzero(left):
        other = right & (root != root[a])
        if within:
            other[: a + 1] = False
        b = np.flatnonzero(other)
        if not len(b):
            continue
        b = b[in_reach(n[b], n[a], np.bitwise_count(sketches[b] ^ sketches[a]).sum(axis=1), percent)]
        _, first = np.unique(root[b], return_index=True)
        links += [(int(a), int(x)) for x in b[first]]
        root[np.isin(root, root[b])] = root[a]
    return links


def candidate_edges(docs: DataFrame, known: DataFrame, classes: DataFrame, size: int, percent: int, path: str) -> DataFrame:
    """Edges (a, b) between class representatives that may be linked; shared keys are kept under ``path``."""
    buckets = 8 * splits(docs)
    of_doc = known.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "f", "g").distinct()
    rep_of = of_doc.join(classes.select("n_shingles", "f", "g", "rep"), ["n_shingles", "f", "g"]).select("doc_id", "rep")
    blocks = F.ceil(F.col("holders") / BLOCK_HOLDERS).cast("int")
    shared_keys(docs, size, percent).write.parquet(path)
    release(docs.sparkSession)
    members = (
        docs.sparkSession.read.parquet(path)
        .join(rep_of, F.col("doc") == F.col("doc_id"))
        .groupBy("gid", "rep")
        .agg(F.max("holders").alias("holders"))
        .join(classes.select("rep", F.col("n_shingles").alias("n"), "sketch"), "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .withColumn("task", F.when(blocks == 1, F.pmod("gid", F.lit(buckets))).otherwise(F.xxhash64("gid", "low", "high")))
        .select("task", "gid", "low", "high", "block", "rep", "n", "sketch")
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["gid", "low", "high", "rep"])
        gid, low, high, block, rep, n = (part[c].to_numpy(np.int64) for c in ("gid", "low", "high", "block", "rep", "n"))
        bits = [np.frombuffer(x, U) for x in part["sketch"]]
        at = np.append(run_starts(gid, low, high), len(gid))
        a, b = [], []
        for i, j in zip(at[:-1], at[1:], strict=True):
            if j - i > 1:
                for x, y in likely_links(folded(bits[i:j]), n[i:j], block[i:j] == low[i], block[i:j] == high[i], percent):
                    a.append(rep[i + x])
                    b.append(rep[i + y])
        a, b = forest(np.array(a, np.int64), np.array(b, np.int64))
        return pd.DataFrame({"a": a, "b": b})

    return members.groupBy("task").applyInPandas(compare, "a long, b long")


def verified_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of links between members flagged ``left`` and members flagged
    ``right``: every such pair is linked in it, connected in it, or no link."""
    n = np.array([len(s) for s in sets])
    root, links, within = np.arange(len(sets)), [], bool((left & right).any())
    bits = sketch_bits(int(n.max(initial=0)), percent)
    sketches = np.stack([sketch(s, bits) for s in sets]) if sets else np.zeros((0, 1), U)
    for a in np.flatnonzero(left):
        other = right & (root != root[a])
        if within:
            other[: a + 1] = False
        b = np.flatnonzero(other)
        if not len(b):
            continue
        differ = np.bitwise_count(sketches[b] ^ sketches[a]).sum(axis=1)
        near = in_reach(n[b], n[a], differ, percent)
        for x in b[near][np.argsort(differ[near], kind="stable")].tolist():
            if root[x] == root[a]:
                continue
            both = len(np.intersect1d(sets[a], sets[x], assume_unique=True))
            if both * 100 >= percent * (n[a] + n[x] - both):
                links.append((int(a), x))
                root[root == root[x]] = root[a]
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id that
    links of at least ``percent`` hundredths reach."""
    spark = prepare(docs.sparkSession)
    buckets = 8 * splits(docs)
    known = fingerprints(docs, size, percent).checkpoint()
    classes = (
        known.where("n_shingles > 0 and doc_id is not null")
        .groupBy("n_shingles", "f", "g")
        .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
        .checkpoint()
    )
    path = scratch(spark, "keys")
    groups = components(candidate_edges(docs, known, classes, size, percent, path))
    discard(spark, path)
    release(spark)

    members = classes.join(groups, classes["rep"] == groups["node"], "left").select(
        "rep", "f", "g", "n_shingles", F.coalesce("root", "rep").alias("group")
    )
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("load")).where("rows > 1")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("load") / BLOCK_SHINGLES)).cast("int")
    dealt = (
        members.join(sizes.select("group", blocks.alias("blocks")), "group")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .select("rep", "f", "g", "group", "blocks", "block")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    paired = (
        texts.join(dealt, "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .withColumn(
            "task",
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(buckets))).otherwise(F.xxhash64("group", "low", "high")),
        )
        .select("task", "group", "low", "high", "block", "rep", "f", "g", "text")
    )

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for (_, low, high), own in part.groupby(["group", "low", "high"]):
            own = own.sort_values("rep")
            data, at = tx.buffers(pa.array(own["text"], pa.string()))
            sets, bounds = sets_of(data, at, size)
            f, g = prints(sets, bounds)
            same = (f == own["f"].to_numpy()) & (g == own["g"].to_numpy())
            rows = np.flatnonzero(same)
            each = [sets[bounds[r] : bounds[r + 1]] for r in rows]
            block, ids = own["block"].to_numpy()[rows], own["rep"].to_numpy()[rows]
            for x, y in verified_links(each, block == low, block == high, percent):
                a.append(ids[x])
                b.append(ids[y])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    links = components(paired.groupBy("task").applyInPandas(verify, "a long, b long"))
    labels = classes.join(links, classes["rep"] == links["node"], "left").select(
        "n_shingles", "f", "g", F.coalesce("root", "rep").alias("component_id")
    )
    # Sets without shingles, and rows without an id, need no label.
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    alone = known.where(own).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.where(~own).join(labels, ["n_shingles", "f", "g"]).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op2_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def oracle(size: int, percent: int) -> str:
    """All pairs that share a shingle, by SQL over the whole table."""
    return f"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END AS s
  FROM lists
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, min(r.b)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


SQL = oracle(4, 85)
