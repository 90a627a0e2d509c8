"""Removal of long repeats with a run-length index (operator 9).

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller doc_id; strings are judged on the input. Steps:

1. Every window of ``length`` bytes has an anchor, the least hash of its short
   substrings, so equal windows have equal anchors. Neighbouring windows with one
   anchor form a region (some dozens of bytes). Regions are exchanged by anchor as
   hashes (``exchange``); equal regions are pre-aggregated in each task.
2. Equal regions of an anchor are a class. The text of one holder of each class is
   fetched, if other documents have the class or the anchor in other surroundings; the
   other holders go along as members, without text.
3. The classes of an anchor meet in one task, which builds a run-length index over
   their distinct texts (``rindex``), streams their matching statistics through it, and
   marks, for every holder and member, the windows that match a text with a smaller
   doc_id. An anchor with very many classes is dealt by whole windows instead, so that no
   task gets them all; members of its classes, and later holders of a region within one
   task of step 1, go as a whole.
4. Marked windows are gathered by document bucket and cut from the texts.

Null text is empty. Rows that share a doc_id are separate texts, and none of them
removes from another. Null doc_ids neither remove nor lose anything. Texts shorter
than ``length`` bytes are kept. An empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from . import text as tx
from .common import prepare, splits, table
from .exchange import bucket_of, pack, run_starts, scatter, squeeze, unpack_all, unsqueeze
from .rindex import RunLengthIndex

U = np.uint64
#: Bits that name a region among those of its anchor, and bits of an anchor that are sent.
REGION, ANCHOR = U(0xFFFFFFFFFFFF), U(0xFFFFFFFFFF000000)
FLUSH = 500_000
#: Undecided regions of one anchor above which they are dealt by whole windows.
HOT = 20_000
#: Index tasks for each document bucket.
FINER = 3
#: Members whose windows are looked at at a time.
PART = 1 << 16
#: Windows are cut into new regions at multiples of this offset.
LONGEST = 128
#: anchor, region, document, row mark, first window, windows
ENTRY = (U, U, np.int64, U, np.int32, np.int16)
#: document, row mark, first window, windows
CUT = (U, np.int64, U, np.int32, np.int16)
#: document, row mark, first window, windows, anchor, flags: 1 dealt by windows, 2 may lose bytes
OPEN = (U, np.int64, U, np.int32, np.int16, U, np.uint8)
#: region, document, row mark, first window, windows
MEMBER = (U, np.int64, U, np.int32, np.int16)
#: document, row mark, first window, windows, flags
PIECE = (U, np.int64, U, np.int32, np.int16, np.uint8)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def regions(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, region hash, text, first window and windows of every region."""
    size = np.maximum(np.diff(at) - length + 1, 0)
    total = int(size.sum())
    if not total:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int16)
    short = max(2, min(20, length // 3))
    prefix = tx.prefix_hash(data)
    n = len(data) - short + 1
    hashes = tx.mix((prefix[short:] - prefix[:-short]) * tx.powers(n, tx.UNBASE))
    least = sliding_min(hashes, length - short + 1)
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    window = at[owner] + inside
    anchor = least[window]
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    new |= inside % LONGEST == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, total))
    begin = window[first]
    whole = tx.span_hash(prefix, begin, begin + count + length - 1)
    # Least hashes are small, so they are mixed again. 40 and 48 bits: two regions are taken as equal if both agree; other anchors with the same bits only meet in one task.
    return tx.mix(anchor[first]) & ANCHOR, whole & REGION, owner[first], inside[first].astype(np.int32), count.astype(np.int16)


def by_document(cut: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) of entries whose first column is a document."""
    bucket = cut[0] % buckets
    order = np.lexsort((cut[0], bucket))
    bucket = bucket[order]
    columns = [c[order] for c in cut]
    at = np.append(run_starts(bucket), len(bucket))
    for i, j in zip(at[:-1], at[1:], strict=True):
        key = np.zeros(j - i, U)
        yield int(bucket[i]), pack([key, *(c[i:j] for c in columns)])


def row_marks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tells apart the texts of rows that share a doc_id."""
    return tx.span_hash(tx.prefix_hash(data), at[:-1], at[1:])


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({c: pd.Series(dtype=object) for c in names})


def repeat_cuts(docs: DataFrame, dealt: DataFrame, name: str, length: int, marked: bool, buckets: int) -> DataFrame:
    """(bucket, cuts): packed windows to remove, by bucket of their documents; ``dealt``
    has the documents with their bucket as column ``name``. It is the very frame that the
    cuts are then applied to, so that Spark shuffles the texts once for both."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, at in tx.slices(batch.column(1)):
                anchor, whole, owner, first, windows = regions(data, at, length)
                mark = row_marks(data, at)[owner] if marked else np.zeros(len(owner), U)
                held.append((anchor, whole, ids[i:][owner], mark, first, windows))
                count += len(anchor)
                if count >= FLUSH:
                    yield from send(held)
                    held, count = [], 0
        if count:
            yield from send(held)

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, whole, doc, mark, first, windows = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((doc, whole, anchor))
        anchor, whole, doc, mark, first, windows = (x[order] for x in (anchor, whole, doc, mark, first, windows))
        starts = run_starts(anchor, whole)
        later = doc > np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))
        stay = ~later
        rows = [(b, p, None) for b, p in scatter([x[stay] for x in (anchor, whole, doc, mark, first, windows)], buckets)]
        if later.any():
            rows += [(b, None, p) for b, p in by_document([x[later] for x in (doc, mark, first, windows)], buckets)]
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "entries": pa.array([r[1] for r in rows], pa.binary()),
                "cuts": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        bucket = int(part["bucket"].iloc[0])
        rows = [(bucket, c, None) for c in part["cuts"] if c is not None]
        anchor, whole, doc, mark, first, windows = unpack_all([x for x in part["entries"] if x is not None], ENTRY)
        order = np.lexsort((doc, whole, anchor))
        anchor, whole, doc, mark, first, windows = (x[order] for x in (anchor, whole, doc, mark, first, windows))
        names = ["bucket", "cuts", "open", "task", "members"]
        rows = [(*r, None, None) for r in rows]
        if not len(anchor):
            return frame(rows, names)
        by_anchor, by_region = run_starts(anchor), run_starts(anchor, whole)
        per_anchor, per_region = (np.diff(np.append(x, len(anchor))) for x in (by_anchor, by_region))
        low, high = np.minimum.reduceat(doc, by_anchor), np.maximum.reduceat(doc, by_anchor)
        region_low = np.repeat(doc[by_region], per_region)
        later = doc > region_low
        shared = np.repeat(low != high, per_anchor)
        classes = np.repeat(np.add.reduceat(np.isin(np.arange(len(anchor)), by_region, assume_unique=True).astype(np.int64), by_anchor), per_anchor)
        followed = np.repeat(np.logical_or.reduceat(later, by_region), per_region)
        undecided = shared & ~later & ((classes > 1) | followed)
        hot = np.repeat(np.add.reduceat(undecided.astype(np.int64), by_anchor), per_anchor) > HOT
        direct, member = later & hot, np.flatnonzero(later & ~hot)
        if direct.any():
            rows += [(b, p, None, None, None) for b, p in by_document([x[direct] for x in (doc, mark, first, windows)], buckets)]
        if undecided.any():
            flags = (hot + 2 * (doc > np.repeat(low, per_anchor))).astype(np.uint8)
            rows += [(b, None, p, None, None) for b, p in by_document([x[undecided] for x in (doc, mark, first, windows, anchor, flags)], buckets)]
        if len(member):
            task = bucket_of(anchor[member], FINER * buckets)  # in order, as anchors are
            at = np.append(run_starts(task), len(member))
            for i, j in zip(at[:-1], at[1:], strict=True):
                pick = member[i:j]
                pick = pick[np.lexsort((doc[pick], whole[pick]))]
                rows.append((bucket, None, None, int(task[i]), pack([x[pick] for x in (whole, doc, mark, first, windows)])))
        return frame(rows, names)

    def fetch(texts: pa.Table, part: pa.Table) -> pa.Table:
        own = int((texts[name] if len(texts) else part["bucket"])[0].as_py())
        rows = [(own * FINER, own, c, None, None, None) for c in part["cuts"].drop_null().to_pylist()]
        rows += [(t, None, None, None, None, m) for t, m in zip(part["task"].to_pylist(), part["members"].to_pylist(), strict=True) if m is not None]
        _, doc, mark, first, windows, anchor, flags = unpack_all(part["open"].drop_null().to_pylist(), OPEN)
        schema = pa.schema([("task", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("cuts", "pieces", "bytes", "members"))])
        made = lambda: pa.table([[r[k] for r in rows] for k in range(6)], schema=schema)
        if not len(doc) or not len(texts):
            return made()
        known = texts["doc_id"].cast(pa.int64()).combine_chunks()
        order = pa.compute.sort_indices(known)[: len(known) - known.null_count]  # nulls are last
        ids = known.take(order).to_numpy()
        data, at = tx.buffers(texts["text"].cast(pa.large_string()).take(order))
        row = np.searchsorted(ids, doc)
        if marked:
            own = row_marks(data, at)
            last = np.searchsorted(ids, doc, "right") - 1
            while (wrong := (own[row] != mark) & (row < last)).any():
                row[wrong] += 1
        begin = at[row] + first
        hot = flags & 1 == 1
        if hot.any():  # one window each, dealt by its content
            times = np.where(hot, windows, 1)
            each = np.repeat(np.arange(len(doc)), times)
            step = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            doc, mark, first, windows, anchor, flags, hot, begin = (x[each] for x in (doc, mark, first, windows, anchor, flags, hot, begin))
            first, begin = (first + step).astype(np.int32), begin + step
            windows = np.where(hot, 1, windows).astype(np.int16)
            anchor[hot] = tx.span_hash(tx.prefix_hash(data), begin[hot], begin[hot] + length)
        bucket = bucket_of(anchor, FINER * buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        sizes = windows.astype(np.int64) + length - 1
        cuts = np.append(run_starts(bucket), len(bucket))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            pick = order[i:j]
            reach = sizes[pick]
            where = np.repeat(begin[pick] - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
            rows.append((int(bucket[i]), None, None, pack([np.zeros(j - i, U), *(x[pick] for x in (doc, mark, first, windows, flags))]), squeeze(data[where].tobytes()), None))
        return made()

    def match(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(b), c) for b, c in zip(part["bucket"], part["cuts"], strict=True) if c is not None]
        has = part[part["pieces"].notna()]
        if len(has):
            _, doc, mark, first, windows, flags = unpack_all(list(has["pieces"]), PIECE)
            data = np.frombuffer(b"".join(map(unsqueeze, has["bytes"])), np.uint8)
            end = np.cumsum(windows.astype(np.int64) + length - 1)
            begin = end - (windows.astype(np.int64) + length - 1)
            whole = tx.span_hash(tx.prefix_hash(data), begin, end)
            # Distinct texts with their smallest document.
            order = np.lexsort((doc, end - begin, whole))
            starts = run_starts(whole[order], (end - begin)[order])
            kind = np.empty(len(doc), np.int64)
            kind[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
            one = order[starts]
            size = (end - begin)[one]
            at = np.concatenate([[0], np.cumsum(size)])
            held = data[np.repeat(begin[one] - at[:-1], size) + np.arange(at[-1])]
            index = RunLengthIndex(held, at, length)
            # Texts of which some holder may lose bytes are streamed through the index.
            region, *members = unpack_all(list(part["members"].dropna()), MEMBER)
            names = whole[one] & REGION
            known = np.argsort(names)
            theirs = known[np.minimum(np.searchsorted(names[known], region), len(known) - 1)]
            if (names[theirs] != region).any():
                raise RuntimeError("a member's class is not in its task")
            streams = np.zeros(len(one), bool)
            streams[kind[flags & 2 == 2]] = True
            streams[theirs] = True
            sent_at = np.concatenate([[0], np.cumsum(size[streams])])
            reach, row = index.matching(held[np.repeat(streams, size)], sent_at)
            lowest = index.lowest(doc[one])[index.group[row]]
            at = np.zeros(len(one), np.int64)
            at[streams] = sent_at[:-1]
            asks = streams[kind]
            doc, mark, first, windows, kind = (np.concatenate([x[asks], y]) for x, y in zip((doc, mark, first, windows, kind), (*members, theirs), strict=True))
            # Each holder's windows against the smallest document that has them.
            cuts = []
            for i in range(0, len(doc), PART):
                count = windows[i : i + PART].astype(np.int64)
                each = i + np.repeat(np.arange(len(count)), count)
                step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                place = at[kind[each]] + step
                gone = (reach[place] >= length) & (lowest[place] < doc[each])
                each, step = each[gone], step[gone]
                new = np.ones(len(each), bool)
                new[1:] = (each[1:] != each[:-1]) | (step[1:] != step[:-1] + 1)
                starts = np.flatnonzero(new)
                run = np.diff(np.append(starts, len(each))).astype(np.int16)
                who = each[starts]
                cuts.append((doc[who], mark[who], (first[who] + step[starts]).astype(np.int32), run))
            if sum(len(c[0]) for c in cuts):
                rows += list(by_document([np.concatenate(x) for x in zip(*cuts, strict=True)], buckets))
        return frame(rows, ["bucket", "cuts"])

    sent = docs.where("doc_id is not null").mapInArrow(gather, "bucket int, entries binary, cuts binary")
    decided = sent.groupBy("bucket").applyInPandas(decide, "bucket int, cuts binary, open binary, task int, members binary")
    fetched = dealt.groupBy(name).cogroup(decided.groupBy("bucket")).applyInArrow(
        fetch, "task int, bucket int, cuts binary, pieces binary, bytes binary, members binary"
    )
    return fetched.groupBy("task").applyInPandas(match, "bucket int, cuts binary")


def with_bucket(docs: DataFrame, buckets: int, name: str = "bucket") -> DataFrame:
    """By id; rows without one, which nothing is cut from, by their text."""
    return docs.withColumn(name, F.coalesce(F.pmod("doc_id", F.lit(buckets)), F.pmod(F.xxhash64("text"), F.lit(buckets))).cast("int"))


def free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` hasn't, whatever the case of letters."""
    taken, name = {c.lower() for c in docs.columns}, "bucket"
    while name in taken:
        name += "_"
    return name


def removed(ids: pa.Array, column: pa.Array, payloads: list[bytes], length: int, marked: bool, whole_characters: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of each text, and which of them go."""
    data, at = tx.buffers(column)
    _, doc, mark, first, windows = unpack_all(payloads, CUT)
    own = row_marks(data, at) if marked else None
    order = np.argsort(doc, kind="stable")
    doc, mark, first, windows = doc[order], mark[order], first[order].astype(np.int64), windows[order]
    for i, x in enumerate(ids.to_pylist()):
        body = data[at[i] : at[i + 1]]
        mine = np.arange(0) if x is None else np.arange(np.searchsorted(doc, x, "left"), np.searchsorted(doc, x, "right"))
        if marked:
            mine = mine[mark[mine] == own[i]]
        edge = np.zeros(len(body) + 1, np.int64)
        np.add.at(edge, first[mine], 1)
        np.add.at(edge, first[mine] + windows[mine] - 1 + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        if whole_characters and gone.any():
            lead = np.flatnonzero((body & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(body))))
        yield body, gone


def planned(docs: DataFrame, length: int) -> tuple[GroupedData, GroupedData, bool]:
    """Documents and what to cut of them, both grouped by bucket, and whether ids repeat."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = 8 * splits(docs) | 1
    marked = bool(slim.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())
    own = free_name(docs)
    dealt = with_bucket(docs, buckets, own)
    cuts = repeat_cuts(slim, dealt, own, length, marked, buckets)
    return dealt.groupBy(own), cuts.groupBy("bucket"), marked


def dedup(docs: DataFrame, length: int = 50, whole_characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of every row.

    ``whole_characters`` keeps a character whose bytes are only partly covered, so
    that what is kept is UTF-8.
    """
    dealt, cuts, marked = planned(docs.select(F.col("doc_id").cast("long"), "text"), length)

    def apply(texts: pa.Table, part: pa.Table) -> pa.Table:
        out = []
        for body, gone in removed(texts["doc_id"], texts["text"], part["cuts"].drop_null().to_pylist(), length, marked, whole_characters):
            kept = body[~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        n, r, s, h, k = zip(*out, strict=True) if out else ([],) * 5
        return pa.table(
            {"doc_id": texts["doc_id"], "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "n_spans": pa.array(s, pa.int64()), "kept_sha256": pa.array(h, pa.string()), "kept": pa.array(k, pa.binary())}
        )

    return (
        dealt.cogroup(cuts)
        .applyInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )


def dedup_texts(docs: DataFrame, length: int = 50) -> DataFrame:
    """All rows and columns, with repeats cut from ``text`` at whole characters, and
    ``n_chars``, if there is one, counted again where something was cut."""
    dealt, cuts, marked = planned(docs, length)
    names = docs.columns

    def apply(texts: pa.Table, part: pa.Table) -> pa.Table:
        kept, changed = [], []
        for body, gone in removed(texts["doc_id"], texts["text"], part["cuts"].drop_null().to_pylist(), length, marked, True):
            changed.append(bool(gone.any()))
            kept.append(body[~gone].tobytes().decode() if changed[-1] else None)
        columns = {c: texts[c] for c in names}
        swap = pa.array(changed, pa.bool_())
        columns["text"] = pa.compute.if_else(swap, pa.array(kept, pa.string()), texts["text"].cast(pa.string()))
        if "n_chars" in names:
            columns["n_chars"] = pa.compute.if_else(swap, pa.array([None if k is None else len(k) for k in kept], texts["n_chars"].type), texts["n_chars"])
        return pa.table(columns)

    return dealt.cogroup(cuts).applyInArrow(apply, docs.schema)


def op9_suffix_array_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


#: Every window of every text, in hexadecimal.
SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, p, substr(h, 2 * p - 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS p FROM texts)
), firsts AS (SELECT w, min(doc_id) AS m FROM windows GROUP BY w),
gone AS (SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE m < doc_id),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 49 AS b FROM numbered GROUP BY doc_id, k),
ends AS (
  SELECT doc_id, k, a, b FROM spans
  UNION ALL SELECT doc_id, 1000000000, length(h) // 2 + 1, NULL FROM texts
), pieces AS (
  SELECT e.doc_id, e.k, substr(t.h, 2 * coalesce(lag(e.b) OVER (PARTITION BY e.doc_id ORDER BY e.k), 0) + 1,
    2 * (e.a - 1 - coalesce(lag(e.b) OVER (PARTITION BY e.doc_id ORDER BY e.k), 0))) AS x, e.b - e.a + 1 AS size
  FROM ends e JOIN texts t USING (doc_id)
)
SELECT doc_id, any_value(length(h) // 2) AS n_bytes, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_removed,
  CAST(count(size) AS BIGINT) AS n_spans, sha256(unhex(string_agg(x, '' ORDER BY k))) AS kept_sha256
FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id
"""
