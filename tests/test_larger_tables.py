"""Figures that must not grow, and results of steps that were rewritten for large tables."""

import glob

import numpy as np
import pyarrow.parquet as pq

from affinity.llm import exchange, suffix_dedup
from affinity.operators import content, factors, kept, tiles


def test_kept_counts_share_beginnings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "work_path", lambda _, name: f"file://{tmp_path}/{name}")
    rows = [(k, " ".join(f"word{(k * 7 + j * j) % 400}" for j in range(120))) for k in range(60)]
    content.weighed(spark.createDataFrame(rows, "item_id long, text string"), None)
    files = glob.glob(f"{tmp_path}/counts/*.parquet")
    assert files
    for file in files:
        found = pq.ParquetFile(file).metadata
        for column in (found.row_group(g).column(c) for g in range(found.num_row_groups) for c in range(found.num_columns)):
            assert column.compression == "ZSTD"
            assert "term" not in column.path_in_schema or "DELTA_BYTE_ARRAY" in column.encodings


def test_lists_found_in_single_precision_are_exact():
    """Values that single precision can't tell apart, or that very many share, come in order of exact value and column."""
    rng = np.random.default_rng(3)
    for exact in (0.5 + rng.integers(-40, 40, (30, 400)) * 1e-9, np.full((30, 400), 0.25), rng.random((30, 400)) * (rng.random((30, 400)) < 0.02)):
        near = tiles.Candidates(7, np.full(30, 1e-6), lambda r, c, exact=exact: exact[r, c])
        near.limit = 3000
        for j in range(0, 400, 50):
            for i in range(0, 30, 8):
                near.add(i, exact[i : i + 8, j : j + 50].astype(np.float32), j)
        row, column, value = near.found()
        want = [(k, c, exact[k, c]) for k in range(30) for c in np.argsort(-exact[k], kind="stable")[:7] if exact[k, c] > 0]
        assert list(zip(row, column, value, strict=True)) == want
        assert sum(len(x[0]) for x in near.parts) <= 3000 + 8 * 50


def test_dense_terms_and_pairs_give_the_same_product():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(90) < 0.9 / (1 + np.arange(90) / 6)) for _ in range(70)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    tile = tiles.Tile(at, np.concatenate(rows), rng.random(at[-1]))
    whole = np.zeros((70, 90))
    whole[tile.rows(), tile.terms] = tile.ws
    assert 0 < tiles.dense_terms(tile, tile) <= 90
    for hot in (0, 5, 90, 200):
        for kind, wrong in ((np.float64, 1e-12), (np.float32, 1e-4)):
            got = tiles.Columns(tile.part(0, 40), hot, kind).times(tile)
            assert got.dtype == kind and np.abs(got - whole @ whole[:40].T).max() < wrong


def test_equal_vectors_are_scored_once(spark, monkeypatch):
    """Lists over rows that share a few vectors agree with all pairs; ties go by id, and what was seen is left out."""
    monkeypatch.setattr(factors, "BLOCK", 60)
    first, kind = factors.alike(np.array([[1.0, 2.0], [1.0, 2.0], [0.0, 2.0]]), np.array([0.5, 0.5, 0.5]))
    assert len(first) == 2 and kind[0] == kind[1] != kind[2]
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(9, 3)).round(2)
    frame = lambda key, n, k: spark.createDataFrame([(i, [float(x) for x in vectors[i * k % 9]], (i * k % 9) / 100) for i in range(1, n)], f"{key} long, features array<double>, bias double")
    users, items = frame("id", 120, 1), frame("item_id", 150, 7)
    pairs = {(int(u), int(i)) for u, i in zip(rng.integers(1, 125, 400), rng.integers(1, 160, 400), strict=True)} | {(5, i) for i in range(1, 148)}
    got = factors.top_n(factors.best_in_blocks(users, items, spark.createDataFrame(sorted(pairs), "id long, item_id long"), 4, 1.0, (-0.5, 1.5), "s"), "s", 4, "id").collect()
    for u in range(1, 120):
        score = lambda i: round(min(max(1.0 + u % 9 / 100 + i * 7 % 9 / 100 + float(vectors[u % 9] @ vectors[i * 7 % 9]), -0.5), 1.5), 6)  # noqa: B023, E731
        want = sorted((-score(i), i) for i in range(1, 150) if (u, i) not in pairs)[:4]
        assert [(-r.s, r.item_id) for r in sorted((r for r in got if r.id == u), key=lambda r: r["rank"])] == want


def test_anchors_are_sent_in_few_bytes():
    rng = np.random.default_rng(2)
    texts = np.concatenate([[0], np.cumsum(rng.integers(200, 900, 500))])
    columns = list(suffix_dedup.regions(rng.integers(97, 123, texts[-1]).astype(np.uint8), texts, 50))
    order = np.lexsort((columns[2], columns[1], columns[0]))
    sent = sum(len(p) for _, p in exchange.scatter([columns[0][order]], 3))
    assert sent / len(order) < 3.9
    assert len(np.unique(columns[0])) > 0.85 * len(order)  # they still tell strings apart; a string cut at LONGEST has one anchor twice
