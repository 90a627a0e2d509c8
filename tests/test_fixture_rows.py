"""The five-item fixture and hand-computed values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from affinity import schemas
from affinity.functions import text as fx
from affinity.operators import balls, catalog, content, evaluate, factors, interactions, kept, recommend, scores, tiles
from affinity.plans import jobs

ITEMS = [
    (1, "Toy Story (1995)", "Adventure|Animation|Children|Comedy|Fantasy", 4.5, 4.0, "862", "/a.jpg", "Toys come alive.", "John Lasseter", "Tom Hanks, Tim Allen, Don Rickles", "en", "pixar animation classic fun childhood"),
    (2, "Jumanji (1995)", "Adventure|Children|Fantasy", 3.0, 2.8, "8844", "/b.jpg", "A board game comes alive.", "Joe Johnston", "Robin Williams, Kirsten Dunst", "en", None),
    (3, "Grumpier Old Men (1995)", "Comedy|Romance", 2.0, 3.5, "15602", None, None, None, None, None, None),
    (4, "Waiting to Exhale (1995)", "Comedy|Drama|Romance", 1.5, 1.2, "31357", None, None, None, None, None, None),
    (5, "Father of the Bride Part II (1995)", "Comedy", 1.0, 0.9, "11862", None, None, None, None, None, None),
]
COLUMNS = "id long, title string, genres string, popularity_score double, trending_score double, tmdb_id string, poster_path string, overview string, director string, cast_list string, original_language string, user_tags string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, COLUMNS)


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [(1, 1, 5.0, "2020-01-01 00:00:00"), (1, 2, 4.0, "2020-01-02 00:00:00"), (1, 3, 2.0, "2020-01-03 00:00:00")]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts string").withColumn("ts", F.to_timestamp("ts"))


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


@pytest.mark.parametrize(("raw", "clean"), [("Toy Story (1995)", "toy story"), ("Spider-Man 2 (2004)", "spiderman 2"), ("Amélie (2001) ", "amélie"), ("Se7en", "se7en")])
def test_clean_title(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(fx.clean_title("t")).first()[0] == clean


def test_scalars(spark):
    df = spark.createDataFrame([("A (1995)", "114709.0", "x"), ("B (19) C", "12345678", None), ("D (1987) E (2001)", None, "")], "t string, i string, p string")
    got = df.select(fx.release_year("t"), fx.decade_token("t"), fx.imdb_id("i"), fx.image_url("u/", "p")).collect()
    assert [tuple(r) for r in got] == [(1995, "decade_1990s", "0114709", "u/x"), (None, "", "12345678", None), (2001, "decade_1980s", None, None)]


def test_filters(items):
    assert len(ids(catalog.filter_genre(items, "Comedy"))) == 4
    assert ids(catalog.filter_genres_all(items, "Adventure, ,Fantasy")) == [1, 2]
    assert ids(catalog.filter_genre(items, "Western")) == []
    assert len(ids(catalog.filter_year(items, "1995"))) == 5
    meta = catalog.page_meta(items, 2, 2).first()
    assert (meta.total_items, meta.total_pages, meta.has_next, meta.has_previous) == (5, 3, True, True)
    assert catalog.page_meta(catalog.filter_genre(items, "Western")).first().total_pages == 1
    assert [r.id for r in catalog.browse(items, sort="trending_score").collect()] == [1, 3, 2, 4, 5]
    assert [r.id for r in catalog.browse(items, size=2, number=3).collect()] == [5]
    assert ids(catalog.search_title(items, "STORY")) == [1]
    assert ids(catalog.search_title(items, "%")) == []
    with pytest.raises(ValueError, match="sort"):
        catalog.browse(items, sort="id; drop")


def test_stats(items, ratings):
    got = catalog.table_stats(items, ratings).first()
    assert (got["items"], got.ratings, got.enriched, got.pending, got.enriched_pct) == (5, 3, 2, 3, 40.0)
    m = scores.matrix_stats(ratings).first()
    assert (m.users, m["items"], m.ratings) == (1, 3, 3)
    assert {r.genre: r["items"] for r in catalog.genre_counts(items).collect()}["Comedy"] == 4


def test_scores(ratings):
    pop = {r.item_id: r.popularity_score for r in scores.popularity(ratings).collect()}
    assert pop[1] == pytest.approx(5 * math.log(2))
    trend = {r.item_id: r.trending_score for r in scores.trending(ratings).collect()}
    assert trend[3] == pytest.approx(2 * math.log(2))
    w = 2 ** (-86400 / 31557600)
    assert trend[2] == pytest.approx(4 * math.log(1 + w))


def test_upserts(spark, items, ratings):
    changes = spark.createDataFrame([(1, 4, 3.5, "2021-01-01 00:00:00"), (1, 1, 1.0, "2021-01-01 00:00:00"), (1, 99, 1.0, "2021-01-01 00:00:00")], "user_id long, item_id long, rating double, ts string").withColumn("ts", F.to_timestamp("ts"))
    out = interactions.rating_upsert(ratings, changes, items, ["ts"])
    assert {r.item_id: r.rating for r in out.collect()} == {1: 1.0, 2: 4.0, 3: 2.0, 4: 3.5}
    assert [r.item_id for r in catalog.user_rows(out, "ts").orderBy("n").collect()] == [1, 4, 3, 2]
    have = ratings.select("user_id", "item_id", F.col("ts").alias("added_at"))
    more = interactions.watchlist_add(have, changes.select("user_id", "item_id", F.col("ts").alias("added_at")), items)
    assert ids(more, "item_id") == [1, 2, 3, 4]
    assert ids(interactions.watchlist_remove(more, changes), "item_id") == [2, 3]
    assert ids(interactions.unmatched_removals(have, changes), "item_id") == [4, 99]
    assert interactions.rejected_ratings(spark.createDataFrame([(0.0,), (None,), (5.0,)], "rating double")).count() == 2
    bins = {r.bin: r.ratings for r in interactions.rating_histogram(ratings).collect()}
    assert len(bins) == 10 and bins[5.0] == 1 and bins[0.5] == 0


def test_kept_lists(spark):
    recs = spark.createDataFrame([(1, i, i) for i in range(1, 31)], "user_id long, item_id long, rank int")
    kept = interactions.kept_recs(recs, 10, "2020-01-01 00:00:00")
    assert kept.count() == 20
    assert interactions.read_recs(kept, 10, "2020-01-01 00:59:59").count() == 10
    assert interactions.read_recs(kept, 10, "2020-01-01 01:00:00").count() == 0
    assert interactions.rec_history(recs, "x", "2020-01-01 00:00:00").first().item_ids == list(range(1, 31))


def test_expired_lists_are_made_anew(spark, tmp_path):
    """Only buckets that have expired or are missing are computed and replaced; reads prune."""
    path, users = str(tmp_path / "recs"), spark.range(40).withColumnRenamed("id", "user_id")
    lists = lambda u, item: u.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).withColumn("item_id", F.col("rank") + item)
    refresh = lambda item, now: {r.user_id for r in interactions.refresh_recs(users, lambda u: lists(u, item), path, 2, now, 5).collect()}
    assert interactions.stored_recs(spark, path) is None
    assert refresh(0, "2020-01-01 00:00:00") == set(range(40))
    assert refresh(10, "2020-01-01 00:59:59") == set()
    bucket = {r.user_id: r.bucket for r in interactions.stored_recs(spark, path).collect()}
    some = {u for u, b in bucket.items() if b < 2}
    interactions.store_recs(lists(users.where(F.col("user_id").isin(sorted(some))), 20), path, 2, "2020-01-01 00:30:00", 5)
    assert refresh(30, "2020-01-01 01:00:00") == set(range(40)) - some
    kept = interactions.read_recs(interactions.stored_recs(spark, path), 2, "2020-01-01 01:00:00")
    assert {(r.user_id, r.item_id) for r in kept.collect()} == {(u, (20 if u in some else 30) + k) for u in range(40) for k in (1, 2)}
    one = interactions.stored_recs(spark, path, [7])
    assert {r.user_id for r in one.collect()} == {7}
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", one._jdf.queryExecution().toString())


def test_scores_from_batches(spark):
    """Whatever the split, and after a rating is replaced, sums give the scores of the whole history."""
    import random

    r = random.Random(9)
    rows = [(u, r.randint(1, 8), r.choice([0.5, 3.0, 5.0]), f"{r.randint(1995, 2001)}-0{r.randint(1, 9)}-11 00:00:00") for u in range(150)]
    frame = lambda x: spark.createDataFrame(x, "user_id long, item_id long, rating double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    old = [(999, 3, 1.0, "1999-05-05 00:00:00")]
    for parts in ([rows], [rows[:1], rows[1:90], rows[90:]], [rows[k::5] for k in range(5)]):
        sums = scores.decayed_sums(frame(old))
        for part in parts:
            sums = scores.merged_sums(sums, scores.decayed_sums(frame(part)))
        sums = scores.merged_sums(sums, scores.decayed_sums(frame(old), -1))
        got = {x.item_id: (x.popularity_score, x.trending_score) for x in scores.scores_of(sums).collect()}
        want = {x.item_id: [x.popularity_score] for x in scores.popularity(frame(rows)).collect()}
        for x in scores.trending(frame(rows)).collect():
            want[x.item_id].append(x.trending_score)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(tuple(v), abs=1e-9) for k, v in want.items())
    assert scores.scores_of(scores.merged_sums(scores.decayed_sums(frame(old)), scores.decayed_sums(frame(old), -1))).count() == 0


def test_exact_sum(spark):
    values = [1e16, 1.0, -1e16] + [0.1] * 10
    assert spark.createDataFrame([(values,)], "x array<double>").select(fx.exact_sum("x").alias("s")).first().s == pytest.approx(2.0, abs=1.01)
    assert spark.createDataFrame([([0.1] * 1000,)], "x array<double>").select(fx.exact_sum("x").alias("s")).first().s == math.fsum([0.1] * 1000)


def test_content(items, ratings):
    docs = items.select(F.col("id").alias("item_id"), fx.feature_text("user_tags").alias("text"))
    assert docs.where("item_id = 3").first().text == "Comedy Romance Comedy Romance Comedy Romance grumpier old men decade_1990s"
    w = content.tfidf(docs)
    assert all(abs(r.s - 1) < 1e-9 for r in w.groupBy("item_id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect())
    similar = content.similar_items(w, 3).collect()
    assert similar and all(r.item_id != r.other_id and 0 < r.similarity <= 1 + 1e-9 for r in similar)
    recs = content.recommend_content(ratings, w, ratings, 5).collect()
    assert {r.item_id for r in recs} <= {4, 5} and [r["rank"] for r in sorted(recs, key=lambda r: r["rank"])] == list(range(1, len(recs) + 1))


@pytest.mark.parametrize("dense", [0.0, 0.01, 10.0])
def test_tiles_against_all_pairs(spark, monkeypatch, dense):
    """Profiles, lists, hybrid lists and closest items, whether terms are dense or not, over
    several chunks, blocks and stripes."""
    import random

    for name, value in (("USERS", 5), ("BLOCK", 9), ("ENTRIES", 60), ("STRIPE", 4), ("DENSE", dense), ("PAIRS", 7)):
        monkeypatch.setattr(tiles, name, value)
    r = random.Random(4)
    items = {i: {t: r.choice([0.25, 0.5, 1.5]) for t in r.sample("abcdefghij", r.randint(1, 6))} for i in range(30)} | {99: {"z": 1.0}}
    liked = {(u, i): r.choice([0.5, 2.0, 4.0]) for u in range(12) for i in r.sample(range(32), r.randint(1, 5))}
    seen = {(u, i) for u in range(12) for i in items if r.random() < 0.2}
    w = spark.createDataFrame([(i, t, x) for i, d in items.items() for t, x in d.items()], "item_id long, term string, w double")
    ratings = spark.createDataFrame([(u, i, x) for (u, i), x in liked.items()], "user_id long, item_id long, rating double")
    v = tiles.vectors(w)
    profile = {}
    for (u, i), x in liked.items():
        for t, y in items.get(i, {}).items():
            profile.setdefault(u, {}).setdefault(t, 0.0)
            profile[u][t] += x * y
    got = {x.user_id: sorted(x.ps) for x in tiles.profiles(ratings, v).collect()}
    assert got.keys() == profile.keys() and all(got[u] == pytest.approx(sorted(p.values())) for u, p in profile.items())
    unit = {u: {t: y / math.sqrt(sum(z * z for z in p.values())) for t, y in p.items()} for u, p in profile.items()}
    want = {(u, i): round(sum(y * d.get(t, 0) for t, y in p.items()), 6) for u, p in unit.items() for i, d in items.items() if (u, i) not in seen}
    dark = spark.createDataFrame([*seen, (1, 555), (777, 1)], "user_id long, item_id long")
    assert {(x.user_id, x.item_id): x.similarity for x in tiles.scores(ratings, v, dark, 50).collect()} == pytest.approx({k: x for k, x in want.items() if x > 0})
    near = {(x.item_id, x.other_id): x.similarity for x in tiles.similar(v, 50).collect()}
    dots = {(i, j): round(sum(y * b.get(t, 0) for t, y in a.items()), 6) for i, a in items.items() for j, b in items.items() if i != j}
    assert near == pytest.approx({k: x for k, x in dots.items() if x > 0})
    shown = [(u, i) for u in range(14) for i in r.sample(sorted(items), 3)]
    got = {(x.user_id, x.item_id): (x.liked_id, x.cosine) for x in tiles.closest(spark.createDataFrame(shown, "user_id long, item_id long"), ratings, v, 0.3).collect()}
    best = {}
    for u, i in shown:
        k = [(-dots[i, j], j) for (x, j) in liked if x == u and j != i and j in items and dots[i, j] > 0.3]
        if k:
            best[u, i] = (min(k)[1], -min(k)[0])
    assert got == best
    # Hybrid lists: users and items that only the model or only the profiles know.
    vector = lambda: [r.choice([-1.0, 0.0, 0.5]) for _ in range(3)]
    users, known = {u: (vector(), 0.1) for u in range(2, 15)}, {i: (vector(), r.choice([0.0, 0.25])) for i in [*range(25), 99, 200]}
    model = {
        "mean": spark.createDataFrame([(2.5,)], "mean double"),
        "users": spark.createDataFrame([(u, p, a) for u, (p, a) in users.items()], "user_id long, features array<double>, bias double"),
        "items": spark.createDataFrame([(i, q, b) for i, (q, b) in known.items()], "item_id long, features array<double>, bias double"),
    }
    monkeypatch.setattr(recommend.s, "CONTENT_POOL", 6)
    lists = {}
    rated = {(u, i) for u, i in liked}
    base = content.profile_ratings(ratings).collect()
    own = {}
    for x in base:
        for t, y in items.get(x.item_id, {}).items():
            own.setdefault(x.user_id, {}).setdefault(t, 0.0)
            own[x.user_id][t] += x.rating * y
    for u, (p, a) in users.items():
        size = math.sqrt(sum(z * z for z in own.get(u, {}).values())) or 1
        near = {i: round(sum(y / size * items[i].get(t, 0) for t, y in own.get(u, {}).items()), 6) for i in items if (u, i) not in rated}
        pool = {i for _, i in sorted((-x, i) for i, x in near.items() if x > 0)[:6]}
        scored = []
        for i, (q, b) in known.items():
            if (u, i) in rated:
                continue
            guess = round(min(5.0, max(0.5, 2.5 + a + b + sum(x * y for x, y in zip(p, q)))), 6)
            scored.append((-round(0.7 * (guess - 0.5) / 4.5 + 0.3 * (near[i] if i in pool else 0), 8), i))
        lists |= {(u, k + 1): i for k, (_, i) in enumerate(sorted(scored)[:4])}
    got = {(x.user_id, x["rank"]): x.item_id for x in recommend.recommend_hybrid(model, ratings, w, 4).collect()}
    assert got == lists


def test_popularity_lists(spark, items, ratings):
    pop = items.select(F.col("id").alias("item_id"), "popularity_score")
    users = spark.createDataFrame([(1,), (0,)], "user_id long")
    got = {(r.user_id, r["rank"]): r.item_id for r in recommend.popularity_topn(users, pop, ratings.unionByName(ratings.withColumn("user_id", F.lit(0).cast("long"))), 2).collect()}
    assert got == {(1, 1): 4, (1, 2): 5, (0, 1): 1, (0, 2): 2}


@pytest.fixture(scope="module")
def model(spark):
    return {
        "mean": spark.createDataFrame([(3.0,)], "mean double"),
        "users": spark.createDataFrame([(1, [1.0, 2.0], 0.5), (2, [0.0, 0.0], -0.5)], "user_id long, features array<double>, bias double"),
        "items": spark.createDataFrame([(1, [0.5, 0.0], 0.2), (2, [1.0, 1.0], 0.0), (4, [-1.0, 0.1], 0.0)], "item_id long, features array<double>, bias double"),
    }


def test_predictions(spark, model):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 9), (9, 1), (9, 9), (2, 2)], "user_id long, item_id long")
    got = {(r.user_id, r.item_id): r.prediction for r in factors.predict(pairs, model).collect()}
    assert got == pytest.approx({(1, 1): 4.2, (1, 2): 5.0, (1, 9): 3.5, (9, 1): 3.2, (9, 9): 3.0, (2, 2): 2.5})
    latent = {(r.item_id, r.other_id): r.similarity for r in factors.similar_items_latent(model["items"], 5).collect()}
    assert latent == {(1, 2): 0.707107, (2, 1): 0.707107}


def test_lists_by_prediction_against_all_pairs(spark, model, monkeypatch):
    monkeypatch.setattr(factors, "BLOCK", 7)
    import random

    r = random.Random(3)
    vector = lambda: [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]
    users = [(u, vector() if u % 5 else None, r.random()) for u in range(20)]
    items = [(i * 3, vector(), r.choice([0.0, 0.5])) for i in range(40)]
    seen = [(u, i * 3) for u in range(20) for i in range(40) if r.random() < 0.3] + [(1, 0), (1, 0), (99, 3), (2, 1000)]
    made = {"mean": model["mean"], "users": spark.createDataFrame(users, model["users"].schema), "items": spark.createDataFrame(items, model["items"].schema)}
    got = {(x.user_id, x["rank"]): (x.item_id, x.prediction) for x in factors.recommend_collab(made, spark.createDataFrame(seen, "user_id long, item_id long"), 4).collect()}
    want = {}
    for u, p, a in users:
        scored = [(-round(min(5.0, max(0.5, 3.0 + a + b + sum(x * y for x, y in zip(p or [0] * 3, q)))), 6), i) for i, q, b in items if (u, i) not in set(seen)]
        want |= {(u, k + 1): (i, -v) for k, (v, i) in enumerate(sorted(scored)[:4])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()})


def test_blocks_are_skipped_exactly(monkeypatch):
    """Clustered vectors: the n best equal those of all pairs, ties too, and most pairs are never computed."""
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 2
    q = np.repeat(centres, 60, axis=0) + rng.choice([0.0, 0.05], (2400, 16))
    p = centres[rng.integers(0, 40, 300)] + rng.normal(size=(300, 16)) * 0.1
    b, base = rng.choice([0.0, 0.25, np.nan], 2400), rng.normal(size=300)
    hidden = (rng.integers(0, 300, 900), rng.integers(0, 2400, 900))
    for clip in ((-1000.0, 1000.0), (-5.0, 40.0)):  # the second makes many equal scores
        shown = balls.Balls(q, b)
        got = shown.scores(p, base, clip, hidden, 10)
        want = np.clip(base[:, None] + p @ q.T + b, *clip)
        want = np.where(np.isnan(want), -np.inf, np.round(want, 6))
        want[hidden] = -np.inf
        ids = np.arange(2400)
        a, z = tiles.best(got, ids, 10, -np.inf), tiles.best(want, ids, 10, -np.inf)
        assert (a[0] == z[0]).all() and np.abs(got[a] - want[z]).max() < 2e-6
        assert (a[1] == z[1]).mean() > 0.999
        if clip[1] == 1000:
            assert shown.computed < 0.5 * shown.whole


def test_popular_lists_stand_in(spark, model, ratings, items, tmp_path):
    """For users that a recommender doesn't know, for cold users, and where there is no model."""
    users = spark.createDataFrame([(1,), (7,)], "user_id long")
    popular = recommend.popularity_topn(users, scores.popularity(ratings), ratings, 2)
    collab = factors.recommend_collab(model, ratings, 2)
    got = {(x.user_id, x["rank"]): (x.item_id, x.prediction) for x in recommend.with_popular(collab, "prediction", users, model["users"], popular).collect()}
    assert {k for k in got if k[0] == 7} == {(7, 1), (7, 2)} and got[7, 1] == (1, pytest.approx(5 * math.log(2))) and got[1, 1] == (4, 2.7)
    factors.save_model(model, f"{tmp_path}/plain")
    w = spark.createDataFrame([(1, "a", 1.0), (4, "a", 0.6), (4, "b", 0.8)], "item_id long, term string, w double")
    factors.save_model(model, f"{tmp_path}/full", w)
    assert factors.load_model(spark, f"{tmp_path}/none") is None and "weights" not in factors.load_model(spark, f"{tmp_path}/plain")
    loaded = factors.load_model(spark, f"{tmp_path}/full")
    assert loaded["weights"].count() == 3
    more = ratings.unionByName(ratings.withColumn("item_id", F.col("item_id") + 10))
    lists = lambda m: {x.user_id: (x.kind, x.message) for x in jobs.routed_lists(m, users, more, 2).collect()}
    assert lists(loaded) == {1: ("hybrid", None), 7: ("popularity_cold_start", schemas.POPULAR_REASON)}
    assert {k for k, _ in lists(None).values()} == {"popularity_cold_start"}


def test_titles_history_and_metrics(spark, items, tmp_path):
    lists = spark.createDataFrame([(1, 2, 0.5)], "item_id long, other_id long, similarity double")
    assert content.titled(lists, items, "other_id").first().title == "Jumanji (1995)"
    recs = spark.createDataFrame([(1, 5, 1), (1, 4, 2)], "user_id long, item_id long, rank int")
    for _ in range(2):
        interactions.append_history(interactions.rec_history(recs, "hybrid", "2020-01-01 00:00:00"), f"{tmp_path}/history")
    assert [x.item_ids for x in spark.read.parquet(f"{tmp_path}/history").collect()] == [[5, 4], [5, 4]]
    assert jobs.read_metrics(spark, f"{tmp_path}/metrics") is None
    jobs.write_metrics(lists.agg(F.count(F.lit(1)).alias("rows")), f"{tmp_path}/metrics", began=1.0, factors=8)
    got = jobs.read_metrics(spark, f"{tmp_path}/metrics").first()
    assert got.rows == 1 and got.factors == 8 and got.training_duration_seconds > 1e9 and got.trained_at.startswith("2")


def test_places_in_the_whole_order(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101) for i in range(300)], "id long, x long").repartition(7)
    got = {r.id: r.place for r in kept.numbered(rows, [F.desc("x"), F.col("id")], "place").collect()}
    want = sorted(range(300), key=lambda i: (-(i * 37 % 101), i))
    assert got == {i: k + 1 for k, i in enumerate(want)}
    assert kept.numbered(rows.limit(0), [F.col("id")], "place").count() == 0


def test_kept_frames_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        kept.work_path(session("yarn", ""), "x")
    assert kept.work_path(session("yarn", "hdfs://a"), "x").startswith("hdfs://a/x-")
    assert kept.work_path(session("local[4]", ""), "x").startswith("/")


def test_cold_users(spark, ratings, model):
    more = ratings.unionByName(ratings.withColumn("item_id", F.col("item_id") + 10))
    users = spark.createDataFrame([(1,), (2,), (9,)], "user_id long")
    assert {r.user_id: r.is_cold for r in recommend.cold_users(users, more, model["users"]).collect()} == {1: False, 2: True, 9: True}


def test_explanations(spark, items, ratings):
    recs = spark.createDataFrame([(1, 4, 4.1, 0.2), (1, 5, 0.5, 0.0)], "user_id long, item_id long, rating_prediction double, content_similarity double")
    w = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (4, "a", 0.6), (4, "b", 0.8)], "item_id long, term string, w double")
    got = {r.item_id: r for r in recommend.explain(recs, ratings, w, items).collect()}
    assert (got[4].because_id, got[4].because_title, got[4].similarity, got[4].genre_overlap, got[4].same_director) == (2, "Jumanji (1995)", 0.8, 0.0, False)
    total = 0.7 * 3.6 / 4.5 + 0.06
    assert (got[4].rating_weight, got[4].content_weight) == (round(0.56 / total, 3), round(0.06 / total, 3))
    assert (got[5].because_id, got[5].rating_weight, got[5].content_weight) == (None, 0.0, 0.0)


def test_metrics(spark, items):
    recs = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 1), (2, 5, 2)], "user_id long, item_id long, rank int")
    test = spark.createDataFrame([(1, 1, 4.0), (1, 3, 3.5), (1, 2, 2.0), (2, 1, 5.0), (3, 1, 1.0)], "user_id long, item_id long, rating double")
    got = {r.user_id: r for r in evaluate.user_metrics(recs, test, 3).collect()}
    assert set(got) == {1, 2}
    assert got[1].precision == pytest.approx(2 / 3) and got[1].recall == 1
    assert got[1].average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert got[1].ndcg == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert got[2].precision == got[2].average_precision == got[2].ndcg == 0
    assert evaluate.catalog_coverage(recs, items).first().coverage == 1.0
    assert evaluate.intralist_diversity(recs, items).first().diversity == pytest.approx((((1 - 3 / 5) + (1 - 1 / 6) + 1) / 3 + (1 - 1 / 3)) / 2, abs=1e-6)
    train = spark.createDataFrame([(9, 1, 1.0), (8, 1, 1.0), (9, 2, 1.0)], "user_id long, item_id long, rating double")
    want = (-sum(math.log2((c + 1) / 8) for c in (2, 1, 0)) / 3 - math.log2(1 / 8)) / 2  # by user, then over users
    assert evaluate.novelty(recs, train, items).first().novelty == pytest.approx(want, abs=1e-6)


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert schemas.STOP_WORDS == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_entry_needs_no_session():
    import subprocess
    import sys

    hide = "import pathlib, glob, zipfile; pathlib.Path.glob = glob.glob = lambda *a, **k: iter(()); zipfile.ZipFile = None; "  # Spark's jars may lie anywhere
    code = hide + "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 80


def test_workers_find_the_package(spark):
    import os

    kept.workers_find_package(spark)
    kept.workers_find_package(spark)
    paths = spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)
    assert sum(os.path.exists(f"{p}/affinity/operators/kept.py") for p in paths) >= 1 and len(paths) == len(set(paths))


def test_sums_over_candidates_are_those_of_the_pairs(spark):
    users = spark.createDataFrame([(1,), (2,), (2,), (None,)], "user_id long")
    items = spark.createDataFrame([(5,), (7,), (7,), (None,)], "item_id long")
    plain = users.crossJoin(items).groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.sum("item_id").alias("ids"))
    by_id = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert by_id(factors.candidate_sums(users, items)) == by_id(plain)
    assert factors.candidate_sums(users, items.limit(0)).count() == 0
    # No step of the plan pairs users with items: work follows the two tables, not their product.
    many = factors.candidate_sums(spark.range(200_000).withColumnRenamed("id", "user_id"), spark.range(200_000).withColumnRenamed("id", "item_id"))
    assert many.agg(F.sum("items")).first()[0] == 200_000**2


def test_ratings_are_found_once_for_a_query(spark):
    from affinity.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.ratings() is t.ratings()
    plan = t.ratings()._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "Window" not in plan


def test_change_files_have_bounded_rows():
    from affinity.streaming import ratings as stream

    for rows in (0, 1, 600_000, 3_600_000, 216_000_000):
        files = stream.files_of(rows)
        assert files % 2 == 0 and files >= 2 and rows <= files * stream.ROWS < rows + 2 * stream.ROWS + 1


def test_vectors_keep_single_precision_and_products_are_of_doubles(spark):
    from affinity.sources.tables import Tables

    assert dict(Tables(spark, "/root/testdata/sf0.001").item_factors().dtypes)["features"] == "array<float>"
    one = spark.sql("SELECT array(CAST(0.1 AS FLOAT), CAST(3e38 AS FLOAT)) AS a").select(fx.dot("a", "a").alias("d")).first().d
    x, y = (float(v) for v in spark.sql("SELECT CAST(CAST(0.1 AS FLOAT) AS DOUBLE), CAST(CAST(3e38 AS FLOAT) AS DOUBLE)").first())
    assert one == x * x + y * y


def test_sides_of_tiles_grow_with_the_tables(spark, monkeypatch):
    assert factors.tile_side(100, 100) == factors.BLOCK and factors.tile_side(900_000, 1_200_000) == factors.SIDE
    sent = lambda n: n * -(-n // factors.tile_side(n, n))  # noqa: E731  (rows sent to tiles)
    assert sent(1_200_000) < 20 * 1_200_000
    for name, value in (("BLOCK", 3), ("SIDE", 7), ("TILES", 2), ("ROWS", 2)):
        monkeypatch.setattr(factors, name, value)
    frame = lambda key, k: spark.createDataFrame([(i, [float(i * k % 7), float(i % 3)], i / 100) for i in range(1, 24)], f"{key} long, features array<double>, bias double")
    users, items = frame("id", 3), frame("item_id", 5)
    seen = spark.createDataFrame([(1, 4), (2, 9), (23, 1)], "id long, item_id long")
    got = factors.top_n(factors.best_in_blocks(users, items, seen, 4, 0.0, (-99.0, 99.0), "s"), "s", 4, "id").collect()
    rows = lambda df, key: {r[key]: (list(r.features), r.bias) for r in df.collect()}
    left, right, gone = rows(users, "id"), rows(items, "item_id"), {tuple(r) for r in seen.collect()}
    for u, (p, a) in left.items():
        want = sorted((-round(a + b + sum(x * y for x, y in zip(p, q, strict=True)), 6), i) for i, (q, b) in right.items() if (u, i) not in gone)[:4]
        assert [(-r.s, r.item_id) for r in sorted((r for r in got if r.id == u), key=lambda r: r["rank"])] == want


def test_terms_are_counted_beside_their_text(spark):
    texts = [(1, "red red fox red fox"), (1, "fox den"), (2, "the of"), (3, None), (4, ""), (5, "den den den")]
    documents = spark.createDataFrame(texts, "item_id long, text string")
    got = {(r.item_id, r.term): r.tf for r in content.term_counts(documents).collect()}
    assert got == {(1, "red"): 3, (1, "fox"): 3, (1, "den"): 1, (1, "red red"): 1, (1, "red fox"): 2, (1, "fox red"): 1, (1, "fox den"): 1, (5, "den"): 3, (5, "den den"): 2}
    plan = content.term_counts(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(item_id" in plan and "term" not in plan.split("Exchange hashpartitioning")[1].split(")")[0]


def test_items_are_sent_as_few_bytes_to_few_tasks(spark, monkeypatch):
    """Vectors of counts and of weights give the same tiles, a task keeps the best over the parts of its
    block, and blocks don't grow with the items until their entries do."""
    import random

    import numpy as np
    import pyarrow as pa

    r = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(r.choice(words[: r.randint(2, 60)]) for _ in range(r.randint(1, 40)))) for i in range(40)] + [(77, "w1 " * 70_000), (78, "")]
    docs = spark.createDataFrame(texts, "item_id long, text string")
    v, w = content.tfidf_vectors(docs), content.tfidf(docs)
    want = {(x.item_id, x.w) for x in w.collect()}
    (packed, idf), (plain, none) = tiles.coded(v), tiles.coded(tiles.vectors(w))
    assert idf is not None and none is None
    for frame, table in ((packed, idf), (plain, None)):
        got = pa.Table.from_batches(frame.toArrow().to_batches(max_chunksize=7))
        tile = tiles.Tile.of(got, table)
        assert {(i, x) for i, a, b in zip(got["item_id"].to_pylist(), tile.at[:-1], tile.at[1:]) for x in tile.ws[a:b]} == want
        assert all((np.diff(tile.terms[a:b]) > 0).all() for a, b in zip(tile.at[:-1], tile.at[1:]))
    assert sum(len(x.v) for x in packed.collect()) == 8 * w.count()
    ratings = spark.createDataFrame([(u, i, r.choice([1.0, 4.0, 5.0])) for u in range(30) for i in r.sample(range(40), 5)], "user_id long, item_id long, rating double")
    lists = lambda: {(x.user_id, x["rank"]): (x.item_id, x.similarity) for x in content.recommend_content(ratings, v, ratings, 4).collect()}
    near = lambda: {(x.item_id, x["rank"]): (x.other_id, x.similarity) for x in content.similar_items(v, 4).collect()}
    whole = lists(), near()
    for name, value in (("CELLS", 90), ("BLOCK", 5), ("TILES", 3), ("STRIPE", 4)):
        monkeypatch.setattr(tiles, name, value)
    assert (lists(), near()) == whole
    monkeypatch.undo()
    assert tiles.blocks_of(120_000, 26_000_000, tiles.TILES) <= 32 and tiles.blocks_of(1_200_000, 260_000_000, tiles.TILES) <= 32


@pytest.mark.parametrize("few", [0, 200_000])
def test_popular_lists_read_few_places_and_rows(spark, monkeypatch, few):
    """Against all pairs, with a user who has rated all but two items and a repeated rating; there is no row
    for each place that a user tries, and lists are made once for the pairs in them."""
    import random

    monkeypatch.setattr(recommend, "FEW", few)
    r = random.Random(2)
    rated = [(u, i) for u in range(-1, 20) for i in r.sample(range(40), r.randint(1, 12))] + [(50, i) for i in range(38)] + [(50, 3)]
    scores = [(i, float(i % 7)) for i in range(40)]
    watched = spark.createDataFrame(rated, "user_id long, item_id long")
    users = spark.createDataFrame([(u,) for u in [*range(-1, 25), 50, 50]], "user_id long")
    lists = recommend.popularity_topn(users, spark.createDataFrame(scores, "item_id long, popularity_score double"), watched, 6)
    want = {}
    for u in [*range(-1, 25), 50]:
        open_ = [(-x, i) for i, x in scores if u <= 0 or (u, i) not in rated]
        want |= {(u, k + 1): (i, -x) for k, (x, i) in enumerate(sorted(open_)[:6])}
    got = lists.collect()
    assert {(x.user_id, x["rank"]): (x.item_id, x.popularity_score) for x in got} == want and len(got) == len(want)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan(lists) and "row_number" not in plan(lists)
    items = spark.createDataFrame([(i, f"A|{'BCD'[i % 3]}") for i in range(40)], "id long, genres string")
    diversity = evaluate.intralist_diversity(lists, items)
    pairs = {u: [0.0 if want[u, a][0] % 3 == want[u, b][0] % 3 else 2 / 3 for a in range(1, 7) for b in range(a + 1, 7) if (u, b) in want] for u in {u for u, _ in want}}
    assert diversity.first()[0] == pytest.approx(sum(sum(p) / len(p) for p in pairs.values()) / len(pairs), abs=1e-6)
    assert plan(diversity).count("array_except") == 1
