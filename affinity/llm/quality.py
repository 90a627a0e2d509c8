"""Text quality by votes of the nearest labelled texts (operator 11).

A text is a vector of hashed terms: its words, and what their bytes look like (four
neighbouring bytes, with letters and digits each taken for one), beside two terms for how
often words repeat. Terms weigh the root of their share of the text times their rarity.
Truncated singular vectors of the labelled sample (latent semantic analysis, in numpy in
one task) make ``DIM`` numbers of them. The labelled vectors are broadcast, cosines with
all of them are computed exactly, in blocks of texts, for every document, and
the nearest vote for their labels with a power of their cosine as weight. Number of voters,
power and the curve that turns votes into a probability are chosen on the sample with each
text's own vote left out, weighted to the labels' shares in the whole table.

The sample is bounded: ``ROWS`` of each label, of at most ``BYTES`` bytes, by hashed id.
Predictions read whole texts. Texts without words have a vector too, of the term
for no words; null reads as empty. Without labelled rows of both kinds every score is the
share of label 1, 0 if there are none. Repeated labels of one document count once each.
Repeated rows get equal scores; a row without an id is scored, not held out, and never
learned from; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import subwords
from . import text as tx
from .common import crc_fold, in_task, prepare, table

U = np.uint64
#: Bounds of the training sample: texts of each label, bytes a text.
ROWS, BYTES = {0: 1500, 1: 2500}, 16_000
#: Bins of words, of looks and of repetition; numbers of a vector; texts of a block.
WORDS, LOOKS, TURNS, DIM, BLOCK = 4096, 4096, 64, 64, 256
TERMS = WORDS + LOOKS + TURNS
VOTERS, POWERS = (5, 15, 45), (1, 8, 32)

#: What a byte looks like: letters by case, digits, bytes outside ASCII; others as they are.
LOOK = np.arange(256, dtype=np.uint64)
LOOK[97:123], LOOK[65:91], LOOK[48:58], LOOK[128:] = 97, 65, 48, 128


@dataclass
class Model:
    constant: float | None
    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    voters: int
    power: int
    slope: float
    shift: float


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Roots of the shares of all terms, a row for each text."""
    n = len(at) - 1
    start, end, doc = tx.words(data, at)
    low = subwords.lowered(data)
    own_start, own_end, own_doc = subwords.letter_runs(low, at)
    letters = tx.span_hash(tx.prefix_hash(low), own_start, own_end)
    hashes = tx.span_hash(tx.prefix_hash(data), start, end)
    out = np.zeros((n, TERMS))
    out[:, :WORDS] = np.bincount(own_doc * WORDS + (letters >> U(52)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    if len(data) > 3:
        look = LOOK[data]
        four = tx.mix(look[:-3] | look[1:-2] << U(8) | look[2:-1] << U(16) | look[3:] << U(24))
        owner = np.searchsorted(at, np.arange(len(four)), "right") - 1
        inside = np.arange(len(four)) + 4 <= at[owner + 1]
        out[:, WORDS : WORDS + LOOKS] = np.bincount(owner[inside] * LOOKS + (four[inside] >> U(52)).astype(np.int64), minlength=n * LOOKS).reshape(n, LOOKS)
    words = np.bincount(doc, minlength=n)
    distinct = np.bincount(doc[np.unique(tx.mix(hashes ^ tx.mix(doc.astype(U))), return_index=True)[1]], minlength=n)
    equal = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    for part in (slice(0, WORDS), slice(WORDS, WORDS + LOOKS)):
        out[:, part] /= np.maximum(out[:, part].sum(axis=1, keepdims=True), 1)
    turns = WORDS + LOOKS
    often = np.where(words > 0, 1 + np.minimum(30, 2 * np.log2(np.maximum(words, 1) / np.maximum(distinct, 1))).astype(np.int64), 0)
    row = np.arange(n)
    out[row, turns + often] = 0.2
    out[row, turns + 32 + (31 * equal / np.maximum(words, 1)).astype(np.int64)] = 0.2
    return np.sqrt(out)


def latent(share: np.ndarray, rarity: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors along the axes."""
    x = (share * rarity) @ axes
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def texts_in_blocks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(at) - 1, BLOCK):
        own = at[i : i + BLOCK + 1]
        yield data[own[0] : own[-1]], own - own[0]


def votes(cosine: np.ndarray, labels: np.ndarray, voters: int, power: int) -> np.ndarray:
    """Weighted share of label 1 among the nearest, as log odds with half a vote each."""
    k = min(voters, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** power
    one = (weight * labels[near]).sum(axis=1)
    unit = 0.5 * np.maximum(weight.max(axis=1), 1e-9)
    return np.log((one + unit) / (weight.sum(axis=1) - one + unit))


def curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and loss of the weighted logistic curve, a little drawn to 0."""
    theta = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        ridge = np.array([1e-3, 1e-3])
        gradient = design.T @ (w * (p - y)) + ridge * theta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
    loss = float((w * (np.logaddexp(0, design @ theta) - y * (design @ theta))).sum())
    return float(theta[0]), float(theta[1]), loss


def fit(texts: list[str], labels: list[int], share: float | None = None, seed: int = 0) -> Model:
    """Axes, labelled vectors, and the vote that is best on the sample itself."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        empty = np.zeros((0, DIM), np.float32)
        return Model(float(y.mean() if share is None else share) if len(y) or share is not None else 0.0, np.zeros(TERMS), np.zeros((TERMS, DIM)), empty, y, 1, 1, 1.0, 0.0)
    shares = np.concatenate([
        counts(data[at[k] : at[min(k + BLOCK, j - i)]], at[k : k + BLOCK + 1] - at[k]).astype(np.float32)
        for i, j, data, at in tx.slices(pa.array(texts, pa.string())) for k in range(0, j - i, BLOCK)
    ])
    rarity = np.log((1 + len(y)) / (1 + (shares > 0).sum(axis=0))) + 1
    x = shares * rarity.astype(np.float32)
    rng = np.random.default_rng(seed)
    # Subspace iteration for the leading singular vectors.
    axes = rng.normal(size=(TERMS, DIM + 16)).astype(np.float32)
    for _ in range(6):
        axes = np.linalg.qr(x.T @ (x @ axes))[0]
    _, _, turn = np.linalg.svd(x @ axes, full_matrices=False)
    axes = (axes @ turn.T)[:, :DIM].astype(np.float64)
    vectors = latent(shares, rarity, axes)
    cosine = vectors @ vectors.T
    np.fill_diagonal(cosine, -1)
    natural = y.mean() if share is None else min(max(share, 1e-3), 1 - 1e-3)
    w = np.where(y == 1, natural / y.mean(), (1 - natural) / (1 - y.mean()))
    best = None
    for k in VOTERS:
        for power in POWERS:
            slope, shift, loss = curve(votes(cosine, y, k, power), y, w)
            if best is None or loss < best[0]:
                best = (loss, k, power, slope, shift)
    return Model(None, rarity, axes, vectors, y, *best[1:])


def scores(m: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of label 1, for each text."""
    if m.constant is not None:
        return np.full(len(at) - 1, m.constant)
    out = []
    for part, own in texts_in_blocks(data, at):
        cosine = latent(counts(part, own), m.rarity, m.axes) @ m.vectors.T
        out.append(1 / (1 + np.exp(-np.clip(m.slope * votes(cosine, m.labels, m.voters, m.power) + m.shift, -30, 30))))
    return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """Fit on at most ROWS labelled rows, chosen by hashed id."""
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").where(allowed).distinct()
    able = marked.join(docs.where(F.octet_length("text") <= BYTES).select("doc_id").distinct(), "doc_id", "left_semi")
    able = able.withColumn("spread", F.xxhash64("doc_id", F.lit(5)))
    # Spark keeps the first of each task, not all.
    first = lambda label: able.where(F.col("quality") == label).orderBy("spread", "doc_id").limit(ROWS[label])
    chosen = first(0).unionByName(first(1)).select("doc_id", "quality")
    rows = (
        docs.where(F.octet_length("text") <= BYTES)
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # the sum of ROWS at most
        .orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id", "text", "quality")
        .limit(sum(ROWS.values()))
        .select("text", "quality")
    )
    share = marked.agg(F.avg("quality")).first()[0]
    return in_task(rows, lambda t: fit(t["text"].to_pylist(), t["quality"].to_pylist(), share)) or fit([], [], share)


def score_texts(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tx.slices(batch.column(1)):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i), "score": pa.array(scores(shared.value, data, at))})

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def op11_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold("doc_id", 5)
    model = train(docs, table(spark, sf_dir, "labels"), fold != 0)
    return score_texts(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")
