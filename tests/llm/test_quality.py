"""Quality votes: held-out accuracy, the vote by plain loops, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from affinity.llm import quality
from affinity.llm.common import crc_fold

SOUNDS = ["ka", "lo", "mi", "ren", "tas", "ul", "é"]


def prose(r, n):
    return " ".join("".join(r.choice(SOUNDS) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def rows(n=700):
    r, out = random.Random(4), []
    for i in range(n):
        text = prose(r, r.randint(5, 150))
        kind = r.random()
        if kind < 0.1:
            text = " ".join(w + r.choice(["###", "%%%"]) for w in text.split())
        elif kind < 0.2:
            text = (text.split()[0] + " ") * r.randint(10, 80)
        out.append((i, text, int(kind >= 0.2)))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    data = rows()
    odd = [(900, None, 0), (901, "", 0), (902, "  ", 0), (903, data[0][1], 0), (None, data[0][1], 0), (904, "x " + data[5][1] * 2000, 0)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data + odd], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in data] + [(3, None, 0), (None, 0, 0)], "doc_id long, quality int, predicted int")
    model = quality.train(docs, labels, crc_fold("doc_id", 5) != 0)
    return data, model, quality.score_texts(docs, model).collect()


def test_accuracy_on_held_out(scored):
    data, model, got = scored
    assert len(got) == len(data) + 6
    by = {x.doc_id: x for x in got if x.doc_id is not None}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80
    assert np.mean([by[i].predicted == y for i, y in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert by[903].score == pytest.approx(by[0].score)


def test_sample_leaves_out_the_fold(spark, scored):
    data, model, _ = scored
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in data)


def test_votes_by_plain_loops(scored):
    data, m, got = scored
    by = {x.doc_id: x.score for x in got}
    for i, text, _ in data[:25]:
        raw = np.frombuffer(text.encode(), np.uint8)
        x = (quality.counts(raw, np.array([0, len(raw)]))[0] * m.rarity) @ m.axes
        x = (x / np.linalg.norm(x)).astype(np.float32)
        near = sorted(((float(v @ x), int(y)) for v, y in zip(m.vectors, m.labels, strict=True)), reverse=True)[: m.voters]
        weight = [max(c, 0) ** m.power for c, _ in near]
        unit = 0.5 * max(weight)
        one = sum(w for w, (_, y) in zip(weight, near, strict=True) if y)
        odds = math.log((one + unit) / (sum(weight) - one + unit))
        assert by[i] == pytest.approx(1 / (1 + math.exp(-m.slope * odds - m.shift)), abs=2e-3)


def test_axes_are_singular_vectors(scored):
    _, m, _ = scored
    assert np.allclose(m.axes.T @ m.axes, np.eye(quality.DIM), atol=1e-4)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.score for x in quality.score_texts(docs, quality.train(docs, none, crc_fold("doc_id", 5) != 0)).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {x.score for x in quality.score_texts(docs, quality.train(docs, ones, crc_fold("doc_id", 5) >= 0)).collect()} == {1.0}
    assert quality.score_texts(docs.limit(0), quality.fit([], [])).count() == 0
