import random

import numpy as np
import pytest

from affinity.llm import decontaminate
from affinity.llm.decontaminate import align, contaminated

WORDS = [a + b + c for a in ("ka", "lo", "mi", "une", "sha") for b in ("ro", "ti", "ex", "é") for c in ("n", "st", "la", "")]


def score(item, text):
    """Smith-Waterman by its recurrence."""
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(text):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a == b else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_recurrence():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 6, r.integers(1, 15)), r.integers(0, 6, r.integers(0, 40))
        assert align(a, b)[0] == score(list(a), list(b))


def data(seed):
    r = random.Random(seed)
    prose = lambda n: [r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n)]
    items = [(i, prose(r.randint(8, 40))) for i in range(30)]
    docs = []
    for d in range(150):
        w = prose(r.randint(0, 150))
        if r.random() < 0.5:
            copy = list(r.choice(items)[1])
            for _ in range(r.choice([0, 0, len(copy) // 8, len(copy) // 4])):
                k = r.randrange(len(copy))
                copy[k : k + r.randint(0, 1)] = prose(r.randint(0, 1))
            k = r.randint(0, len(w))
            w[k:k] = copy
        docs.append((d, w))
    return items, docs


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_matches_full_alignment(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    items, docs = data(2)
    d = spark.createDataFrame([(i, " ".join(w).title() + ".", 1) for i, w in docs] + [(500, None, 1), (501, "", 1), (3, " ".join(docs[3][1]), 1), (None, " ".join(items[0][1]), 1)], "doc_id long, text string, score int").repartition(3)
    i = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items] + [(100, None, "x"), (101, "not there", "x")], "item_id long, text string, doc_id string")
    rows = contaminated(d, i).collect()
    got = {(x.doc_id, x.item_id): x.score for x in rows}
    assert len(got) == len(rows)
    texts = {k: [x.lower() for x in w] for k, w in docs} | {None: items[0][1]}
    want = {}
    for dk, w in texts.items():
        for ik, v in items:
            s = score(v, w) / (2 * len(v))
            if s >= 0.5:
                want[dk, ik] = s
    assert got == pytest.approx(want)
    spans = {(x.doc_id, x.item_id): x for x in rows}
    x = spans[None, 0]
    assert " ".join(items[0][1]).encode()[x.first_byte : x.last_byte].decode() == " ".join(items[0][1])


def test_a_leak_in_most_documents_is_found(spark):
    item = " ".join(WORDS[:20])
    d = spark.createDataFrame([(k, f"a{k} b{k} {item} c{k}") for k in range(300)], "doc_id long, text string")
    assert contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 300


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(d, none).count() == 0
    assert contaminated(d.limit(0), spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")).count() == 0


def test_short_items(spark):
    items = [(1, "Kalo"), (2, "kalo, mi"), (3, "une sha ro ti ex"), (4, "?!"), (5, "Une sha ro ti ex"), (6, " ".join(WORDS[:12])), (7, "the quick brown fox jumps")]
    docs = [(1, "x kalo mi kalo"), (2, "kalo. MI"), (3, "kalomi une sha ro ti"), (4, "a une sha ro  ti-ex b"), (5, "mi"), (6, ""), (7, "the quick brown fox leaps"), (8, "une sha x ti ex"), (9, "une sha x ro")]
    got = {(x.doc_id, x.item_id, x.score, x.first_byte, x.last_byte) for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    exact = {(1, 1, 1.0, 2, 6), (1, 2, 1.0, 2, 9), (2, 1, 1.0, 0, 4), (2, 2, 1.0, 0, 8), (4, 3, 1.0, 2, 19), (4, 5, 1.0, 2, 19)}
    assert got == exact | {(3, 3, 0.8, 7, 20), (3, 5, 0.8, 7, 20), (7, 7, 0.8, 0, 19), (8, 3, 0.7, 0, 15), (8, 5, 0.7, 0, 15)}


def edited(r, prose, item):
    w = list(item)
    for _ in range(r.choice([0, 1, 1, max(1, len(w) // 6)])):
        k = r.randrange(len(w))
        w[k : k + r.randint(0, 1)] = prose(r.randint(0, 1))
    return w


@pytest.mark.parametrize(("shortest", "longest", "least"), [(1, 7, 1.0), (8, 40, 0.98)])
def test_recall_of_seeds(spark, shortest, longest, least):
    """Full alignment of every document with every item, next to what seeds find."""
    r = random.Random(shortest)
    prose = lambda n: [r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n)]
    items = [(i, prose(r.randint(shortest, longest))) for i in range(40)]
    docs = [(d, prose(r.randint(0, 30)) + edited(r, prose, r.choice(items)[1]) + prose(r.randint(0, 30))) for d in range(250)]
    rows = contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): x.score for x in rows}
    best = {(d, i): score(v, w) for d, w in docs for i, v in items}
    size = {i: 2 * len(v) for i, v in items}
    want = {(d, i): s / size[i] for (d, i), s in best.items() if s >= min(6, size[i]) and s >= 0.5 * size[i]}
    assert set(got) <= set(want) and len(got) >= least * len(want)
    assert len(want) > 150 and all(got[k] == pytest.approx(want[k]) for k in got)
