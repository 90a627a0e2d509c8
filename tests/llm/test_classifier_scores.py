"""Scores of fixed models against plain loops over characters and words."""

import math
import random
import re

import numpy as np
import pytest

from affinity.llm import langid, toxicity
from affinity.llm import text as tx
from affinity.llm.common import in_task
from tests.llm.test_classifiers import prose


def letter_words(text):
    """Lower-cased runs of letters and of bytes above ASCII, as bytes."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text or "")
    return re.findall(rb"[a-z\x80-\xff]+", low.encode())


def bucket(gram, bits):
    key = 0
    for b in gram:
        key = (key * 0x01000193 & 0xFFFFFFFF) ^ b
    key = (key ^ (key >> 15)) * 0x85EBCA6B & 0xFFFFFFFF
    return key >> (32 - bits)


def grams(word, size, bits):
    framed = b" " + word + b" "
    return [bucket(framed[i : i + size], bits) for i in range(len(framed) - size + 1)]


def texts(seed):
    r = random.Random(seed)
    out = [prose(r, r.choice(["aa", "bb", "cc"]), r.randint(1, 90)) for _ in range(40)]
    return out + [None, "", "12 ?!", "x", "É" * 9, "Ka. LO-mi", " ".join(["ka"] * 100)] + out[:3]


def test_language_scores(spark):
    rng = np.random.default_rng(1)
    model = langid.Model(["aa", "bb", "cc"], rng.normal(size=(1 << langid.BITS, 3)), rng.normal(size=3), 1.7, 0.6)
    rows = list(enumerate(texts(4)))
    rows[7] = (None, rows[7][1])
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int").repartition(3)

    def plain(t):
        found = [b for size in langid.SIZES for w in letter_words(t) for b in grams(w, size, langid.BITS)]
        if not re.search(r"[^\W\d_]", t or ""):
            return ("und", 0.0, True)
        x = [(sum(model.table[b][k] for b in found) / len(found) + model.bias[k]) / model.temperature for k in range(3)]
        e = [math.exp(v - max(x)) for v in x]
        best = max(range(3), key=lambda k: e[k])
        return (model.names[best], e[best] / sum(e), e[best] / sum(e) < model.reject_below)

    got = sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred, round(r.score, 9), r.rejected) for r in langid.identify(docs, model).collect())
    assert got == sorted((-1 if d is None else d, p[0], round(p[1], 9), p[2]) for d, t in rows for p in [plain(t)])


def test_toxicity_scores(spark):
    rng = np.random.default_rng(2)
    words = [b"ka", b"lo", b"kalo", "éta".encode()]
    name = lambda w: int(tx.span_hash(tx.prefix_hash(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0])
    model = toxicity.start_model(np.sort(np.array([name(w) for w in words], np.uint64)), rng)
    model.p["word"] = rng.normal(size=model.p["word"].shape).astype(np.float32)
    model.p["word"][0] = 0
    model.slope, model.shift = 1.3, -0.2
    p = {k: v.astype(float) for k, v in model.p.items()}
    h = toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(w):
        at = np.flatnonzero(model.words == np.uint64(name(w)))
        b = [x for size in toxicity.GRAM_SIZES for x in grams(w, size, toxicity.GRAM_BITS)]
        return np.concatenate([p["word"][at[0] + 1 if len(at) else 0], np.mean([p["gram"][x] for x in b], axis=0) if b else np.zeros(toxicity.GRAM_DIM)])

    def window(xs):
        states = []
        for side, order in ((0, xs), (1, xs[::-1])):
            s, run = np.zeros(h), []
            for x in order:
                g, u = x @ p[f"w{side}"] + p[f"b{side}"], s @ p[f"u{side}"]
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
                run.append(s)
            states.append(run if side == 0 else run[::-1])
        hs = [np.concatenate(x) for x in zip(*states)]
        if not hs:
            return p["ob"][0]
        e = np.array([np.tanh(x @ p["a"] + p["ab"]) @ p["v"] for x in hs])
        e = np.exp(e - e.max())
        return sum(a * x for a, x in zip(e / e.sum(), hs)) @ p["o"] + p["ob"][0]

    def plain(t):
        xs = [vector(w) for w in letter_words(t)]
        starts = range(0, max(1, len(xs) - toxicity.STEP), toxicity.STEP)  # overlapping by half, to the end
        top = max(window(xs[i : i + toxicity.SPAN]) for i in starts)
        return 1 / (1 + math.exp(-(model.slope * top + model.shift)))

    rows = list(enumerate(texts(5)))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows] + [(None, rows[0][1], 1)], "doc_id long, text string, predicted int").repartition(3)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    assert {d: r.score for d, r in got.items()} == pytest.approx({d: plain(t) for d, t in rows} | {None: plain(rows[0][1])}, abs=1e-4)
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def test_work_of_one_task(spark):
    made = in_task(spark.range(100).repartition(5), lambda t: (t.num_rows, sum(t["id"].to_pylist())))
    assert made == (100, 4950)
    assert in_task(spark.range(0), lambda t: t.num_rows) in (None, 0)


def test_learning_needs_ids(spark):
    """Rows without an id are read and not held out, and never learned from; repeated rows are alike."""
    r = random.Random(6)
    rows = [(i, prose(r, lang, 20), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[1][1], "zz"), (None, rows[1][1], "zz")], "doc_id long, text string, lang string")
    model = langid.train(docs, langid.crc_fold("doc_id", 3) != 1)
    assert model.names == ["aa", "bb"]
    got = langid.identify(docs, model).collect()
    same = [(x.lang_pred, x.score) for x in got if x.doc_id is None]
    assert len(got) == 63 and len(set(same)) == 1 and same[0][0] == "bb"
