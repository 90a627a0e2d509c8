"""Language identification (operator 1).

A text is the average of the embeddings of its hashed subwords: byte n-grams
inside its lower-cased letter runs, with word ends. A linear softmax on the
average gives the language. Embeddings and softmax are trained together by
stochastic gradient descent in numpy, in one task, on a bounded sample of labelled rows
(``PER_CLASS`` texts of each of at most ``CLASSES`` languages). Part of the sample
is held back to fit the temperature that calibrates the scores, and the score
below which a prediction is rejected.

The average and the softmax are linear, so a trained model is one table of
logits for each subword bucket, which scores whole texts of any length.

Null text, or text without a letter: ``und``, score 0, rejected. With no labelled
row at all everything is ``und``. Repeated rows get equal results; a row without an id
is read, not held out, and never learned from; an empty table gives none; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import subwords
from . import text as tx
from .common import crc_fold, in_task, prepare, table

BITS, DIM = 16, 16
SIZES = (2, 3, 4)
#: Bounds of the training sample: texts a language, languages, bytes a text.
PER_CLASS, CLASSES, BYTES = 600, 64, 20_000
#: Times as many rows of a label as are needed are compared.
FEW = 4
#: Share of wrong predictions that rejection aims at among those it keeps.
WRONG = 0.01


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # logits by subword bucket
    bias: np.ndarray
    temperature: float
    reject_below: float


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of all texts and the text of each word's last one."""
    low = subwords.lowered(data)
    start, end, doc = subwords.letter_runs(low, at)
    frame, bounds = subwords.framed(low, start, end)
    buckets, owners = [], []
    for size in SIZES:
        bucket, begin = subwords.grams(frame, bounds, size, BITS)
        buckets.append(bucket)
        owners.append(np.repeat(doc, np.diff(begin)))
    return np.concatenate(buckets), np.concatenate(owners)


def averages(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean of rows of ``values`` by owner; zero for owners without rows."""
    count = np.bincount(owner, minlength=n)
    total = np.stack([np.bincount(owner, values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)
    return total / np.maximum(count, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 0) -> Model:
    """Train on the texts and calibrate on every fifth of them."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    docs = []
    for i, j, data, at in tx.slices(pa.array(texts, pa.string())):
        bucket, owner = features(data, at)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(j - i + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids, counts = np.unique(bucket[order[a:b]], return_counts=True)
            docs.append((ids, (counts / max(1, b - a)).astype(np.float32)))
    held = np.arange(len(docs)) % 5 == 4 if len(docs) >= 20 * len(names) else np.zeros(len(docs), bool)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for d in rng.permutation(train):
            ids, share = docs[d]
            if not len(ids):
                continue
            hidden = share @ emb[ids]
            g = softmax(hidden @ out + bias)
            g[y[d]] -= 1
            back = out @ g
            out -= step * np.outer(hidden, g)
            bias -= step * 0.1 * g
            emb[ids] -= 100 * step * share[:, None] * back  # a bucket holds a small share of a text
    logits = emb.astype(np.float64) @ out
    check = np.flatnonzero(held) if held.any() else train
    raw = np.array([docs[d][1] @ logits[docs[d][0]] + bias for d in check]).reshape(len(check), len(names))
    grid = np.geomspace(0.2, 20, 60)
    loss = [-np.log(softmax(raw / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    score = softmax(raw / heat)
    best = score.max(axis=1)
    right = score.argmax(axis=1) == y[check]
    order = np.argsort(-best)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= WRONG)
    # Between the least score kept and the greatest one below it.
    cut = best[order[fine[-1]]] if len(fine) else 1.0
    return Model(names, logits, bias.astype(np.float64), heat, float(min(cut, 0.99)))


def sample(docs: DataFrame, label: str, allowed: Column) -> DataFrame:
    """At most PER_CLASS rows of each of the CLASSES most frequent labels: the first by
    hashed id. Only hashes that are small for the label's frequency are compared, some
    FEW times as many as are needed, so a label of many rows is no large group."""
    slim = docs.where(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= BYTES) & F.col("text").rlike(r"\p{L}"))
    slim = slim.select("doc_id", label, F.xxhash64("doc_id", F.lit(11)).alias("spread"), F.xxhash64("text").alias("print"))
    most = slim.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), label).limit(CLASSES)
    low = F.pmod("spread", F.lit(1 << 30)) * F.col("rows") < FEW * PER_CLASS * (1 << 30)
    return (
        slim.join(F.broadcast(most), label)  # CLASSES rows
        .where(low)
        .withColumn("spread", F.pmod("spread", F.lit(1 << 30)))
        .withColumn("n", F.row_number().over(Window.partitionBy(label).orderBy("spread", "doc_id", "print")))
        .where(F.col("n") <= PER_CLASS)
    )


def train(docs: DataFrame, allowed: Column) -> Model | None:
    """Fit on the bounded sample of rows that ``allowed`` admits."""
    ids = sample(docs, "lang", allowed).select("doc_id").distinct()
    rows = (
        docs.where(allowed & F.col("lang").isNotNull() & (F.octet_length("text") <= BYTES) & F.col("text").rlike(r"\p{L}"))
        .join(F.broadcast(ids), "doc_id", "left_semi")  # PER_CLASS * CLASSES ids at most
        .select("doc_id", "text", "lang")
        .orderBy("doc_id", "text", "lang")
        .limit(PER_CLASS * CLASSES)
        .select("text", "lang")
    )
    return in_task(rows, lambda t: fit(t["text"].to_pylist(), t["lang"].to_pylist()) if len(t) else None)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; ``rejected`` marks scores
    below the calibrated bound, which a filter should read as ``und``."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, at in tx.slices(batch.column(1)):
                n = j - i
                letters = np.array(batch.column(2).slice(i, n).fill_null(False).to_pylist(), bool)
                if m is None:
                    name, score = ["und"] * n, np.zeros(n)
                    low = np.ones(n, bool)
                else:
                    bucket, owner = features(data, at)
                    p = softmax((averages(m.table[bucket], owner, n) + m.bias) / m.temperature)
                    score = np.where(letters, p.max(axis=1), 0.0)
                    name = [m.names[k] if has else "und" for k, has in zip(p.argmax(axis=1), letters, strict=True)]
                    low = score < m.reject_below
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0).slice(i, n), "lang_pred": pa.array(name), "score": pa.array(score), "rejected": pa.array(low)}
                )

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("text").rlike(r"\p{L}").alias("letters")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold("doc_id", 3)
    model = train(docs, fold != 1)
    return identify(docs, model).select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
