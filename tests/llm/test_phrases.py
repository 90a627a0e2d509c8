"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from affinity.llm import phrases


def plain(rows, least, percent, n):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                covered[lang, w[i : i + k]] = max(covered[lang, w[i : i + k]], a)
    out = {}
    for (lang, w), a in cand.items():
        if 100 * covered[lang, w] >= percent * a:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:n]))


def rows(size=300):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "data", "set", "é", "naïve", "x\x00y", "a-b", "new", "york", "city", "very"] + [f"w{i}" for i in range(40)]
    out = [("en", None), (None, ""), ("fr", "   \t"), (None, "york " * 300), ("en", "new york city. " * 60), ("de", "new york\tcity very\nnew york " * 40)]
    for _ in range(size):
        words = [vocabulary[min(len(vocabulary) - 1, int(rng.expovariate(0.12)))] + rng.choice(["", "", "", ",", ".", "!"]) for _ in range(rng.randint(0, 120))]
        out.append((rng.choice(["en", "en", "de", None]), " ".join(words)))
    return out


@pytest.mark.parametrize("flush,held", [(1 << 21, 1 << 23), (500, 300)])
def test_equals_plain_counts(spark, monkeypatch, flush, held):
    monkeypatch.setattr(phrases, "FLUSH", flush)
    monkeypatch.setattr(phrases, "HELD", held)
    data = rows()
    docs = spark.createDataFrame([(lang, text, 1) for lang, text in data], "lang string, text string, phrase int").repartition(3)
    got = sorted(map(tuple, phrases.collocations(docs, least=5, percent=80, n=400).collect()))
    assert got == plain(data, 5, 80, 400)


def test_flushes_and_merges(monkeypatch):
    """Small flushes give the same counts as one; merged rows weigh the same."""
    data = [(lang, text or "") for lang, text in rows(80)]

    def entries(parts):
        seen = Counter()
        for part in parts:
            flush = phrases.Flush()
            for lang, text in part:
                raw = np.frombuffer(text.encode(), np.uint8)
                flush.add([lang], raw, np.array([0, len(raw)]))
            if flush.n:
                table, _, words, names = flush.entries()
                for kind, *w, c in table.tolist():
                    seen[names[kind // 3], kind % 3, tuple(words[x] for x in w)] += c
        return seen

    whole, some = entries([data]), entries([data[i : i + 7] for i in range(0, len(data), 7)])
    assert whole == some
    keys = np.random.default_rng(1).integers(0, 4, (500, 4))
    weight = np.arange(500)
    one, heavy = phrases.merged(keys, weight)
    want = Counter()
    for k, w in zip(map(tuple, keys.tolist()), weight.tolist(), strict=True):
        want[k] += w
    assert dict(zip(map(tuple, one.tolist()), heavy.tolist(), strict=True)) == dict(want)


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(2)
    keys = rng.zipf(1.4, (3000, 4)).clip(max=60)
    keys[rng.random((3000, 4)) < 0.1] = 0
    weight = rng.integers(1, 9, 3000)
    want = Counter()
    for k, w in zip(keys.tolist(), weight.tolist(), strict=True):
        for d in range(1, 5):
            if k[d - 1] == 0:
                break
            want[tuple(k[:d])] += w
    got = {}
    for at, depth, heavy in phrases.quicksort(keys, weight, 25):
        for p, d, h in zip(at.tolist(), depth.tolist(), heavy.tolist(), strict=True):
            assert tuple(keys[p, :d].tolist()) not in got
            got[tuple(keys[p, :d].tolist())] = h
    assert got == {k: w for k, w in want.items() if w >= 25}


def test_nothing_frequent(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "one two three"), (None, None)], "lang string, text string")).count() == 0


def test_counts_past_64_bits(spark):
    """Scores of counts whose products need more than 64 bits."""
    found = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 9_200_000_000_000_000_000)], "a long, l long, r long")
    score = found.selectExpr("CAST(a AS DECIMAL(20,0)) * 2000000BD DIV (CAST(l AS DECIMAL(20,0)) + r) AS score").first().score
    assert score == 2000000 * 9_000_000_000_000_000_000 // 18_300_000_000_000_000_000


def test_query_equals_sql(spark, tmp_path):
    data = [(i, lang, text) for i, (lang, text) in enumerate(rows(900))]
    spark.createDataFrame(data, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = phrases.op13_phrase_collocations(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.sql(phrases.SQL).project(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 50
