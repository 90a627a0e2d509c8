"""Toxicity by a bidirectional gated recurrent network (operator 10).

A word's input is its own embedding (for words seen in training) beside the mean
embedding of its hashed byte n-grams, so an unseen word is judged by its
characters. Windows of ``SPAN`` words that overlap by half run through a forward
and a backward gated recurrent layer; attention pools the states, and a logistic
unit scores the window. A text's score is that of its highest window, calibrated.
All windows of all texts are scored.

Training is numpy in one task, on a bounded sample of labelled rows (``ROWS`` of each label, of
at most ``BYTES`` bytes): Adam on windows. A toxic text's label says nothing of
where, so its windows are those whose words speak most for the label in the
sample (smoothed log odds by document), and after the first round those that the
network itself scores highest; clean texts give random windows, their highest
scoring ones, and windows that repeat one or two of their words. Every sixth sampled text is held back to calibrate the score.

Null, empty and wordless texts are one window without words; its pooled state is
zero. Without labelled rows of both kinds every score is the share of toxic
labels, 0 if there are none. Repeated labels of one document count once each.
Repeated rows get equal scores; a row without an id is scored, not held out, and never
learned from; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import subwords
from . import text as tx
from .common import crc_fold, in_task, prepare, table
from .exchange import run_starts

U, R = np.uint64, np.float32
SPAN, STEP = 32, 16
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
GRAM_BITS, GRAM_SIZES = 15, (3, 4)
#: Bounds of the training sample (texts of each label, bytes a text) and of the word table.
ROWS, BYTES, WORDS = {0: 1600, 1: 600}, 8_000, 30_000
#: Windows that run through the network at a time.
BATCH = 4096
#: Words whose n-grams are averaged at a time.
PART = 1 << 16


@dataclass
class Windows:
    """Words of texts as arrays, and the windows over them."""

    word: np.ndarray  # hash of each word
    gram: np.ndarray  # n-gram buckets, word by word
    gram_at: np.ndarray
    place: np.ndarray  # (windows, SPAN) word numbers, -1 behind the last
    text: np.ndarray  # of each window


def windows(data: np.ndarray, at: np.ndarray) -> Windows:
    low = subwords.lowered(data)
    start, end, doc = subwords.letter_runs(low, at)
    word = tx.span_hash(tx.prefix_hash(low), start, end)
    frame, bounds = subwords.framed(low, start, end)
    parts = [subwords.grams(frame, bounds, size, GRAM_BITS) for size in GRAM_SIZES]
    count = sum(np.diff(begin) for _, begin in parts)
    gram_at = np.concatenate([[0], np.cumsum(count)])
    gram, offset = np.empty(gram_at[-1], np.int32), gram_at[:-1].copy()
    for bucket, begin in parts:
        own = np.diff(begin)
        gram[np.repeat(offset - begin[:-1], own) + np.arange(len(bucket))] = bucket
        offset += own
    n = len(at) - 1
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    number = np.maximum(1, -(-(words - STEP) // STEP))
    text = np.repeat(np.arange(n), number)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * STEP
    place = begin[:, None] + np.arange(SPAN)
    place = np.where(place < words[text][:, None], place + first[text][:, None], -1)
    return Windows(word, gram, gram_at, place, text)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return R(1) / (R(1) + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of known words
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def word_ids(self, word: np.ndarray) -> np.ndarray:
        """Row of each word's embedding; 0 for unknown words."""
        if not len(self.words):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at + 1, 0)

    def inputs(self, w: Windows, ids: np.ndarray) -> np.ndarray:
        """Input of every word, and one of zeros for place -1."""
        out = np.zeros((len(w.word) + 1, WORD_DIM + GRAM_DIM), R)
        out[:-1, :WORD_DIM] = self.p["word"][ids]
        count = np.diff(w.gram_at)
        for i in range(0, len(count), PART):
            own = count[i : i + PART]
            begin = w.gram_at[i : i + len(own)]
            part = w.gram[begin[0] : begin[-1] + own[-1]]
            if len(part):
                sums = np.add.reduceat(self.p["gram"][part], np.minimum(begin - begin[0], len(part) - 1), axis=0)
                out[i : i + len(own), WORD_DIM:] = np.where(own[:, None] > 0, sums / np.maximum(own, 1)[:, None], 0)
        return out

    def logits(self, w: Windows) -> np.ndarray:
        x = self.inputs(w, self.word_ids(w.word))
        out = np.empty(len(w.place), R)
        for i in range(0, len(w.place), BATCH):
            place = w.place[i : i + BATCH].T
            out[i : i + BATCH] = self.forward(x[place], (place >= 0).astype(R))[0]
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        """Logits of windows: x is (SPAN, windows, inputs)."""
        p, (steps, n, _) = self.p, x.shape
        h = np.empty((steps, n, 2 * HIDDEN), R)
        tape = []
        for side, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            wx, uh, b = p[f"w{side}"], p[f"u{side}"], p[f"b{side}"]
            gates = x.reshape(steps * n, -1) @ wx + b
            gates = gates.reshape(steps, n, 3 * HIDDEN)
            state = np.zeros((n, HIDDEN), R)
            for t in order:
                hu = state @ uh
                zr = R(1) / (R(1) + np.exp(-(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                m = mask[t][:, None]
                after = state + m * (R(1) - z) * (new - state)
                if keep:
                    tape.append((side, t, state, z, r, new, hu[:, 2 * HIDDEN :]))
                state = after
                h[t, :, side * HIDDEN : (side + 1) * HIDDEN] = state
        a = np.tanh(h.reshape(steps * n, -1) @ p["a"] + p["ab"]).reshape(steps, n, ATTEND)
        score = a @ p["v"] - R(1e4) * (R(1) - mask)
        weight = np.exp(score - score.max(axis=0)) * mask
        weight /= np.maximum(weight.sum(axis=0), R(1e-9))
        pooled = (weight[:, :, None] * h).sum(axis=0)
        logit = pooled @ p["o"] + p["ob"][0]
        return logit, (x, mask, h, tape, a, weight, pooled)

    def backward(self, g: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of x, for gradients g of the logits."""
        p, (x, mask, h, tape, a, weight, pooled) = self.p, kept
        steps, n, _ = x.shape
        d = {"o": pooled.T @ g, "ob": np.array([g.sum()], R)}
        back = g[:, None] * p["o"]
        dh = weight[:, :, None] * back
        along = (h * back).sum(axis=2)
        ds = weight * (along - (weight * along).sum(axis=0))
        d["v"] = np.einsum("tn,tnk->k", ds, a)
        da = ds[:, :, None] * p["v"] * (1 - a * a)
        flat = da.reshape(steps * n, -1)
        d["a"], d["ab"] = h.reshape(steps * n, -1).T @ flat, flat.sum(axis=0)
        dh += (flat @ p["a"].T).reshape(h.shape)
        dx = np.zeros((steps * n, x.shape[2]), R)
        for side in (0, 1):
            u = p[f"u{side}"]
            du, dgates, carry = np.zeros_like(u), np.zeros((steps, n, 3 * HIDDEN), R), np.zeros((n, HIDDEN), R)
            for _, t, state, z, r, new, hu in reversed([q for q in tape if q[0] == side]):
                m = mask[t][:, None]
                total = dh[t, :, side * HIDDEN : (side + 1) * HIDDEN] + carry
                live = total * m
                dnew = live * (1 - z) * (1 - new * new)
                dz = live * (state - new) * z * (1 - z)
                dr = dnew * hu * r * (1 - r)
                dgates[t] = np.concatenate([dz, dr, dnew], axis=1)
                inner = np.concatenate([dz, dr, dnew * r], axis=1)
                du += state.T @ inner
                carry = total * (1 - m) + live * z + inner @ u.T
            flat = dgates.reshape(steps * n, -1)
            d[f"w{side}"], d[f"u{side}"], d[f"b{side}"] = x.reshape(steps * n, -1).T @ flat, du, flat.sum(axis=0)
            dx += flat @ p[f"w{side}"].T
        return d, dx.reshape(x.shape)


def start_model(words: np.ndarray, rng: np.random.Generator) -> Model:
    size = WORD_DIM + GRAM_DIM
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(R)
    p = {"word": draw(len(words) + 1, WORD_DIM, s=0.1), "gram": draw(1 << GRAM_BITS, GRAM_DIM, s=0.3)}
    p["word"][0] = 0
    for side in (0, 1):
        p |= {f"w{side}": draw(size, 3 * HIDDEN, s=0.4), f"u{side}": draw(HIDDEN, 3 * HIDDEN, s=0.25), f"b{side}": np.zeros(3 * HIDDEN, R)}
    p |= {"a": draw(2 * HIDDEN, ATTEND, s=0.3), "ab": np.zeros(ATTEND, R), "v": draw(ATTEND, s=0.3), "o": draw(2 * HIDDEN, s=0.3), "ob": np.zeros(1, R)}
    return Model(words, p)


def log_odds(w: Windows, toxic: np.ndarray) -> np.ndarray:
    """Of each word and of its most telling n-gram, the greater, by document."""
    doc = np.zeros(len(w.word), np.int64)
    rows, cols = np.nonzero(w.place >= 0)
    doc[w.place[rows, cols]] = w.text[rows]
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())

    def telling(kind: np.ndarray, owner: np.ndarray, kinds: int) -> np.ndarray:
        pairs = kind.astype(np.int32 if kinds * len(toxic) < 1 << 31 else np.int64)
        pairs *= len(toxic)
        pairs += owner
        pairs.sort()
        pairs = pairs[run_starts(pairs)]
        feature, who = pairs // len(toxic), pairs % len(toxic)
        pos = np.bincount(feature, toxic[who], kinds)
        neg = np.bincount(feature, ~toxic[who], kinds)
        return (np.log((pos + 0.1) / (n1 + 0.2)) - np.log((neg + 0.5) / (n0 + 1.0))).astype(R)[kind]

    names, flat = np.unique(w.word, return_inverse=True)
    value = telling(flat, doc, len(names))
    if len(w.gram):
        each = telling(w.gram, np.repeat(doc.astype(np.int32), np.diff(w.gram_at)), 1 << GRAM_BITS)
        best = np.maximum.reduceat(each, np.minimum(w.gram_at[:-1], len(each) - 1))
        value = np.maximum(value, np.where(np.diff(w.gram_at) > 0, best, value))
    return value


def best_window(score: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The highest scoring window of each text."""
    order = np.lexsort((-score, text))
    return order[np.searchsorted(text[order], np.arange(n))]


def learn(model: Model, w: Windows, ids: np.ndarray, chosen: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, moments: dict) -> None:
    """Adam over the chosen windows with targets y, each class with half the weight."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    size = 128
    for _ in range(epochs):
        for at in range(0, len(chosen), size):
            if at == 0:
                order = rng.permutation(len(chosen))
            pick = order[at : at + size]
            place = w.place[chosen[pick]].T
            words, flat = np.unique(place, return_inverse=True)
            flat = flat.reshape(place.shape)
            real = words >= 0
            own = np.where(real, ids[words], 0)
            own[rng.random(len(own)) < 0.4] = 0  # so that characters are learned too
            begin, count = w.gram_at[words * real], np.where(real, w.gram_at[words * real + 1] - w.gram_at[words * real], 0)
            spread = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            grams, holder = w.gram[spread], np.repeat(np.arange(len(words)), count)
            x = np.zeros((len(words), WORD_DIM + GRAM_DIM), R)
            x[:, :WORD_DIM] = model.p["word"][own]
            np.add.at(x[:, WORD_DIM:], holder, model.p["gram"][grams])
            x[:, WORD_DIM:] /= np.maximum(count, 1)[:, None]
            mask = (place >= 0).astype(R)
            x[~real] = 0
            logit, kept = model.forward(x[flat], mask, keep=True)
            g = ((sigmoid(logit) - y[pick]) * weight[pick] / len(pick)).astype(R)
            d, dx = model.backward(g, kept)
            each = np.zeros((len(words), x.shape[1]), R)
            np.add.at(each, flat.ravel(), dx.reshape(-1, x.shape[1]))
            each[~real] = 0
            dw = np.zeros_like(model.p["word"])
            np.add.at(dw, own, each[:, :WORD_DIM])
            dw[0] = 0
            dg = np.zeros_like(model.p["gram"])
            np.add.at(dg, grams, (each[:, WORD_DIM:] / np.maximum(count, 1)[:, None])[holder])
            d |= {"word": dw, "gram": dg}
            moments["t"] = moments.get("t", 0) + 1
            for k, v in d.items():
                m, s = moments.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
                m += R(0.1) * (v - m)
                s += R(0.01) * (v * v - s)
                t = moments["t"]
                model.p[k] -= R(0.01) * (m / R(1 - 0.9**t)) / (np.sqrt(s / R(1 - 0.99**t)) + R(1e-6))


def fit(texts: list[str], labels: list[int], share: float | None = None, seed: int = 0) -> Model:
    """Train and calibrate; ``share`` of toxic texts is what scores are calibrated
    for, that of the sample if not given."""
    toxic = np.array(labels, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(np.zeros(0, U), constant=float(toxic.mean()) if len(toxic) else 0.0)
    rng = np.random.default_rng(seed)
    data, at = tx.buffers(pa.array(texts, pa.string()))
    w = windows(data, at)
    held = np.arange(len(texts)) % 6 == 5
    if len(texts) < 60 or not (toxic & held).any() or (toxic & ~held).sum() < 2:
        held[:] = False
    doc = np.zeros(len(w.word), np.int64)
    rows, cols = np.nonzero(w.place >= 0)
    doc[w.place[rows, cols]] = w.text[rows]
    known, at_word = np.unique(w.word[~held[doc]], return_inverse=True)
    often = np.bincount(at_word, minlength=len(known))
    model = start_model(np.sort(known[np.argsort(-often, kind="stable")[:WORDS]]), rng)
    ids = model.word_ids(w.word)
    value = np.append(np.where(held[doc], -9, log_odds(w, toxic & ~held)), -99)
    score = value[w.place].max(axis=1)
    moments: dict = {}
    free = ~held[w.text]
    clean_windows = np.flatnonzero(free & ~toxic[w.text])
    hard: list[np.ndarray] = []
    # Clean texts also stand for ones that repeat a word over and over.
    clean_words = np.flatnonzero(~held[doc] & ~toxic[doc])
    if len(clean_words):
        again = np.repeat(rng.choice(clean_words, 1500)[:, None], SPAN, axis=1)
        again[:750, SPAN // 2 :] = rng.choice(clean_words, 750)[:, None]
        w.place = np.concatenate([w.place, again])
    real, drills = len(w.text), np.arange(len(w.text), len(w.place))
    for turn, epochs in enumerate((5, 2, 2, 2, 2)):
        top = best_window(score, w.text, len(texts))
        positive = top[toxic & ~held]
        if turn:
            hard.append(top[~toxic & ~held])
        random = rng.choice(clean_windows, min(len(clean_windows), 2 * len(positive) + 1500), replace=False)
        negative = np.unique(np.concatenate([random, drills, *hard]))
        chosen = np.concatenate([positive, negative])
        learn(model, w, ids, chosen, (np.arange(len(chosen)) < len(positive)).astype(R), epochs, rng, moments)
        score = model.logits(w)[:real]
    top = score[best_window(score, w.text, len(texts))].astype(np.float64)
    check = held if held.any() else ~held
    share = toxic.mean() if share is None else min(max(share, 0.001), 0.999)
    cut = best_cut(top, toxic, share)
    model.slope = slope_at(top[check] - cut, toxic[check], share)
    model.shift = -model.slope * cut
    return model


def weights(y: np.ndarray, share: float) -> np.ndarray:
    """Of texts, so that ``share`` of the weight is on toxic ones."""
    return np.where(y, share / max(1, y.sum()), (1 - share) / max(1, (~y).sum())) * len(y)


def best_cut(x: np.ndarray, y: np.ndarray, share: float) -> float:
    """The cut with the least weighted error, in the middle of the widest such gap."""
    order = np.argsort(x, kind="stable")
    x, w = x[order], weights(y, share)[order] * np.where(y[order], 1, -1)
    error = np.cumsum(w)[:-1]  # up to a constant, with the cut behind each text but the last
    gap = np.diff(x)
    open_ = gap > 1e-9
    if not open_.any():
        return float(x[0])
    least = error[open_].min()
    at = np.flatnonzero(open_ & (error <= least + 1e-9))
    at = at[np.argmax(gap[at])]
    return float((x[at] + x[at + 1]) / 2)


def slope_at(x: np.ndarray, y: np.ndarray, share: float) -> float:
    """Slope of the logistic curve through 1/2 at 0 that fits best on a grid, with one
    imagined text of each kind so that it stays finite."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    w, grid = weights(y, share), np.geomspace(0.05, 5, 60)
    loss = [(w * (np.logaddexp(0, a * x) - target * a * x)).sum() for a in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """Fit on at most ROWS labelled rows, chosen by hashed id."""
    marked = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").where(allowed).distinct()
    fits = docs.where((F.octet_length("text") > 0) & (F.octet_length("text") <= BYTES)).select("doc_id").distinct()
    able = marked.join(fits, "doc_id", "left_semi").withColumn("spread", F.xxhash64("doc_id", F.lit(7)))
    # The first by hashed id of each label; Spark keeps as many in each task, not all.
    first = lambda label: able.where(F.col("toxic") == label).orderBy("spread", "doc_id").limit(ROWS[label])
    chosen = first(0).unionByName(first(1)).select("doc_id", "toxic")
    rows = (
        docs.where((F.octet_length("text") > 0) & (F.octet_length("text") <= BYTES))
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # the sum of ROWS at most
        .orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id", "text")
        .limit(sum(ROWS.values()))
        .select("text", "toxic")
    )
    share = marked.agg(F.avg("toxic")).first()[0]
    return in_task(rows, lambda t: fit(t["text"].to_pylist(), t["toxic"].to_pylist(), share)) or fit([], [])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, at in tx.slices(batch.column(1)):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i), "score": pa.array(scores(m, data, at))})

    return (
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(run, "doc_id long, score double")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def clean_only(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Rows, with all their columns, whose score is under ``limit``."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tx.slices(batch.column(column)):
                yield batch.slice(i, j - i).filter(pa.array(scores(shared.value, data, at) < limit))

    return docs.mapInArrow(run, docs.schema)


def scores(m: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(at) - 1, m.constant)
    w = windows(data, at)
    first = np.searchsorted(w.text, np.arange(len(at) - 1))
    top = np.maximum.reduceat(m.logits(w), first).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(m.slope * top + m.shift, -30, 30)))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 5) != 0)
    return score_texts(docs, model).select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
