import random
import re

import numpy as np
import pytest

from affinity.llm import jaccard
from affinity.llm.components import components
from affinity.llm.jaccard import near_duplicates


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower() if (t or "").isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), -1 if d is None else low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=250):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 400)}É" for _ in range(r.choice([3, 5, 8, 20, 60, 150, 400]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 2)] = [f"x{r.randint(0, 99)}"] * r.randint(0, 2)
            w = w or ["z"]
        rows.append((i * 7 % 1000, r.choice([" ", "\n", " \t"]).join(x.upper() if r.random() < 0.2 else x for x in w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (None, rows[0][1]), (6000, rows[0][1]), (6000, rows[0][1])]
    return rows


def result(spark, rows, size, percent, parts=3):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int").repartition(parts)
    out = near_duplicates(docs, size, percent).collect()
    return sorted((-1 if x.doc_id is None else x.doc_id, x.n_shingles, -1 if x.component_id is None else x.component_id) for x in out)


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_matches_brute_force(spark, seed, size, percent):
    rows = corpus(seed)
    assert result(spark, rows, size, percent) == brute(rows, size, percent)


def test_blocks_and_many_sends(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_HOLDERS", 5)
    monkeypatch.setattr(jaccard, "FLUSH", 300)
    rows = corpus(4)
    assert result(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_never_miss_a_pair():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        keep = r.random(len(a)) >= r.choice([0, 0.05, 0.1])
        b = np.unique(np.concatenate([a[keep], r.integers(0, 1 << 62, int(len(a) * r.choice([0, 0.04, 0.1]))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            k, d = jaccard.piece_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85)
            assert set(k[d == 0]) & set(k[d == 1])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 300), (300, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {300: 200}


def test_components_raise_if_not_settled(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="settled"):
        components(path, rounds=2)
    assert {r.root for r in components(path).collect()} == {0}
