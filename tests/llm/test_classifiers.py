import random
import zlib

import numpy as np
import pytest

from affinity.llm import langid, toxicity
from affinity.llm.common import crc_fold

SOUNDS = {"aa": ["ka", "lo", "mi"], "bb": ["shr", "ex", "unt"], "cc": ["éta", "ñu", "oç"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize()


def test_language_accuracy_on_held_out(spark):
    r = random.Random(1)
    rows = [(i, prose(r, lang, r.randint(3, 60)), lang, "s") for i, lang in enumerate(r.choices(list(SOUNDS), k=600))]
    odd = [(600, None, "aa", "s"), (601, "", "bb", "s"), (602, "12 !? 3", "cc", "s"), (603, rows[0][1], None, "s"), (604, "x" + " kalo" * 30000, "aa", "s")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows + odd], "doc_id long, text string, lang string, source string, score double").repartition(3)
    model = langid.train(docs, crc_fold("doc_id", 3) != 1)
    assert model.names == ["aa", "bb", "cc"]
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert len(got) == 605
    held = [(i, lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.98
    assert all(0 <= x.score <= 1 for x in got.values())
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (600, 601, 602))
    assert got[604].lang_pred == "aa"
    assert got[603].lang_pred == rows[0][2]


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.train(docs, crc_fold("doc_id", 3) != 1) is None
    assert [x.lang_pred for x in langid.identify(docs, None).collect()] == ["und"]
    assert langid.identify(docs.limit(0), None).count() == 0


def toxic_rows(r, n):
    rows = []
    for i in range(n):
        w = prose(r, "aa", r.randint(1, 120)).split()
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w) + 1), "grum" + r.choice(SOUNDS["aa"]) * r.randint(1, 2))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out(spark):
    r = random.Random(2)
    rows = toxic_rows(r, 500)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(900, None, 0), (901, "", 0), (902, "?!", 0), (903, "kalo " * 40000, 0)], "doc_id long, text string, predicted int").repartition(2)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels, crc_fold("doc_id", 5) != 0)
    got = {x.doc_id: x for x in toxicity.score_texts(docs, model).collect()}
    assert len(got) == 504
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert all(got[i].predicted == 0 for i in (900, 901, 902, 903))
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.score for x in toxicity.score_texts(docs, toxicity.train(docs, none, crc_fold("doc_id", 5) != 0)).collect()] == [0.0, 0.0]
    assert toxicity.score_texts(docs.limit(0), toxicity.Model(np.zeros(0, np.uint64), constant=0.0)).count() == 0


@pytest.mark.parametrize("name", ["w0", "u1", "b0", "a", "v", "o"])
def test_gradients(name):
    rng = np.random.default_rng(3)
    m = toxicity.start_model(np.zeros(0, np.uint64), rng)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = rng.normal(size=(toxicity.SPAN, 3, 16)), np.ones((toxicity.SPAN, 3))
    mask[9:, 1] = 0
    mask[:, 2] = 0
    weight = np.array([1.0, -2.0, 0.5])
    _, kept = m.forward(x, mask, keep=True)
    toxicity_h = kept[2].astype(np.float64)
    assert np.isfinite(toxicity_h).all()
    d, _ = m.backward(weight, kept)
    at = tuple(0 for _ in m.p[name].shape)
    step = 1e-2
    values = []
    for sign in (1, -1):
        m.p[name][at] += sign * step
        values.append(float((weight * m.forward(x, mask)[0]).sum()))
        m.p[name][at] -= sign * step
    assert abs((values[0] - values[1]) / (2 * step) - d[name][at]) < 2e-3 * max(1, abs(d[name][at]))
