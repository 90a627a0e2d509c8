"""Periodic runs against plain loops."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from affinity.llm import runs


def plain_runs(words):
    """Every lag's maximal stretches; of equal stretches the smallest lag."""
    n, found = len(words), {}
    for lag in range(1, n):
        i = lag
        while i < n:
            if words[i] != words[i - lag]:
                i += 1
                continue
            begun = i
            while i < n and words[i] == words[i - lag]:
                i += 1
            if i - begun + lag >= max(12, 2 * lag):
                key = (begun - lag, i)
                found[key] = min(lag, found.get(key, lag))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts():
    rng = random.Random(5)
    out = ["", "   ", "a", "a " * 11, "a " * 12, "a " * 2000, "a b " * 6 + "c", ("a b a " * 9 + "x ") * 5]
    fib = ["a", "a b"]
    while len(fib[-1]) < 1200:
        fib.append(fib[-1] + " " + fib[-2])
    out.append(fib[-1])
    for size in (2, 3, 20):
        for n in (13, 40, 90, 250):
            out.append(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:size]) for _ in range(n)))
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
            parts += (unit * rng.randint(1, 7))[: rng.randint(1, 120)]
        out.append(" ".join(parts))
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, "x"), (7, "a b " * 6 + "c", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    return rows, runs.find_runs(docs).collect()


def test_equals_plain_loops(found):
    rows, got = found
    known = {(r.doc_id, r.n_words): [tuple(x) for x in r.runs] for r in got}
    assert len(got) == len(rows)
    for who, text, _ in rows:
        words = (text or "").split()
        assert known[who, len(words)] == plain_runs(words), (who, text)


def test_collapsed_texts(found):
    rows, got = found
    by = {(r.doc_id, r.n_words): r.collapsed for r in got}
    for who, text, _ in rows:
        words = (text or "").split()
        keep = [True] * len(words)
        for s, n, q in plain_runs(words):
            keep[s + q : s + n] = [False] * (n - q)
        assert by[who, len(words)] == " ".join(w for w, k in zip(words, keep, strict=True) if k)


def test_repetitive_text_takes_few_steps():
    """One word, two words and a long period: openings grow as n log n, active lags stay few."""
    for n in (20_000, 40_000):
        for unit in (1, 2, 500):
            codes = runs.tx.mix(np.arange(n, dtype=np.uint64) % np.uint64(unit))
            word, _ = runs.openings(codes, np.array([0, n]))
            assert len(word) <= 2 * n
    words = [b"a"] * 30_000
    word, lag = runs.openings(runs.tx.mix(np.zeros(30_000, np.uint64)), np.array([0, 30_000]))
    assert runs.follow(words, list(zip(word.tolist(), lag.tolist(), strict=True))) == [(0, 30_000, 1)]


def test_empty_table(spark):
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 90))), "en") for i in range(150)] + [(500, None, None), (501, "ö é ö é", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op12_periodic_runs(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.sql(runs.SQL)
        assert sorted(got.columns) == sorted(want.columns)
        want = want.project(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r[1] for r in want)
    assert hashlib.sha256(b"").hexdigest() in {r[-1] for r in want}
