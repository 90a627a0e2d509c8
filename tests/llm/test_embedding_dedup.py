import numpy as np
import pytest

from affinity.llm import embedding_dedup
from affinity.llm.embedding_dedup import Shard, near_pairs
from affinity.llm.hnsw import Graph, unit


def rows(seed, dim=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(15, dim))
    x = [centres[r.integers(15)] + r.normal(size=dim) * r.choice([0.05, 0.15, 0.3]) for _ in range(400)] + list(r.normal(size=(100, dim)))
    out = [(int(i) * 3, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    out += [(5000 + i, out[7][1]) for i in range(40)] + [(6000, [2 * a for a in out[7][1]]), (6001, [-a for a in out[7][1]])]
    out += [(7000, None), (7001, [0.0] * dim), (7002, [None] + [1.0] * (dim - 1)), (7003, [float("nan")] + [1.0] * (dim - 1)), (7004, [float("inf")] * dim), (7005, []), (7006, [1.0, 2.0]), (7007, [2.0, 4.0]), (None, out[7][1]), (5001, out[7][1])]
    return out


def brute(data, least):
    good = {d: np.array(v, float) for d, v in data if d is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v)}
    ids = sorted(good)
    links = {d: set() for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a]) / np.sqrt(good[b] @ good[b]) >= least:
                links[a].add(b)
                links[b].add(a)
    low = {d: d for d in ids}
    for _ in ids:
        new = {d: min([low[d], *(low[x] for x in links[d])]) for d in ids}
        if new == low:
            break
        low = new
    return sorted((-1, 0, -1, True) if d is None else (d, len(links.get(d, ())), low.get(d, d), low.get(d, d) == d) for d, _ in data)


def result(spark, data, least=0.9):
    frame = spark.createDataFrame([(d, v, 1) for d, v in data], "vec_id long, embedding array<float>, n_links int").repartition(3)
    return sorted((-1 if x.vec_id is None else x.vec_id, x.n_links, -1 if x.component_id is None else x.component_id, x.kept) for x in near_pairs(frame, least).collect())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_SHARDS", 2)
    data = rows(1)
    assert result(spark, data) == brute(data, 0.9)


def test_dense_cluster(spark):
    """A thousand near copies of one vector, at the query's parameters."""
    r = np.random.default_rng(9)
    data = [(i, (r.normal(size=24) * 0.02 + (np.arange(24) == 3)).astype(np.float32).tolist()) for i in range(1000)]
    data += [(1000 + i, r.normal(size=24).astype(np.float32).tolist()) for i in range(500)]
    assert result(spark, data) == brute(data, 0.9)


def test_empty(spark):
    assert near_pairs(spark.createDataFrame([], "vec_id long, embedding array<float>"), 0.9).count() == 0


def shard_of(x, weights=None):
    leaders, ball = embedding_dedup.balls(x.astype(np.float32))
    made = Shard(x, np.arange(len(x)) * 3, np.ones(len(x), np.int64) if weights is None else weights, ball, leaders)
    return Shard(made.x, made.ids, made.weights, ball, leaders, made.graph.pack())


def moved(x, cosine, seed=3):
    aside = np.random.default_rng(seed).normal(size=x.shape)
    aside = unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * aside


@pytest.mark.parametrize("clusters", [3, 200, 3000])
def test_recall(clusters):
    """At the parameters of the query, against brute force."""
    r = np.random.default_rng(2)
    x = unit(r.normal(size=(clusters, 32))[r.integers(0, clusters, 3000)] + 0.15 * r.normal(size=(3000, 32)))
    q = moved(x, 0.96)
    links, _, _ = shard_of(x).query(q, -1 - np.arange(len(q)), 0.9)
    truth = (q @ x.T >= 0.9).sum(axis=1)
    assert (links <= truth).all() and links.sum() >= 0.98 * truth.sum()


def test_every_node_is_found_by_a_moved_copy():
    x = unit(np.random.default_rng(5).normal(size=(1250, 64)))
    graph = Graph.unpack(x, Graph.build(x).pack())
    q, node = graph.within(moved(x, 0.95), 0.9, embedding_dedup.BEAM, embedding_dedup.SLACK)
    assert set(range(1250)) == set(node[q == node])  # node 0 too


def test_dense_cluster_of_any_spread():
    """A thousand points around one, tight and loose, among others; each links like brute force says."""
    r = np.random.default_rng(6)
    for spread in (0.01, 0.03, 0.045):
        x = np.concatenate([unit(unit(r.normal(size=(1, 64))) + spread * r.normal(size=(1000, 64))), unit(r.normal(size=(500, 64)))])
        weights = r.integers(1, 4, 1500)
        shard = shard_of(x, weights)
        assert spread > 0.04 or len(shard.nodes) < 600
        links, a, b = shard.query(x, shard.ids, 0.9)
        truth = x @ x.T >= 0.9
        np.fill_diagonal(truth, False)
        assert links.sum() >= 0.99 * (truth @ weights).sum() and (links <= truth @ weights).all()
        assert {*a, *b} == {*(3 * np.flatnonzero(truth.any(axis=1)))} and len(a) < 1500


def test_failed_audit_ends_in_exact_comparison(monkeypatch):
    monkeypatch.setattr(Graph, "within", lambda self, q, *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    x = unit(np.random.default_rng(7).normal(size=(300, 16)))
    q = moved(x, 0.95)
    links, _, _ = shard_of(x).query(q, -1 - np.arange(300), 0.9)
    assert links.tolist() == (q @ x.T >= 0.9).sum(axis=1).tolist()


def test_audit_leaves_self_matches_out(monkeypatch):
    """Only links to other points count: a graph that finds each point itself and nothing else fails."""
    x = unit(np.random.default_rng(8).normal(size=(200, 16)))
    x = np.concatenate([x, moved(x, 0.95)])
    monkeypatch.setattr(Graph, "within", lambda self, q, *_: tuple(np.nonzero(q @ self.x.T > 0.99999)))
    assert shard_of(x).beam(x, np.arange(400) * 3, 0.9) is None


def test_wide_vectors_make_more_shards(spark, monkeypatch):
    assert embedding_dedup.shards_for(1000, 64_000, 4) == embedding_dedup.LEAST_SHARDS
    assert embedding_dedup.shards_for(1_000_000, 64_000_000, 4) == 10
    for dim in (64, 4096, 100_000):
        shards = embedding_dedup.shards_for(1_000_000, 1_000_000 * dim, 8)
        assert 1_000_000 / shards * dim * 8 <= embedding_dedup.SHARD_BYTES and 1_000_000 / shards <= embedding_dedup.SHARD
    monkeypatch.setattr(embedding_dedup, "SHARD_BYTES", 12 * 4 * 40)
    data = rows(10)
    monkeypatch.setattr(embedding_dedup, "LEAST_SHARDS", 1)
    assert embedding_dedup.shards_for(500, 500 * 12, 4) == 13
    assert result(spark, data) == brute(data, 0.9)
