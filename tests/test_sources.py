import random
import re

import pytest
from pyspark.sql import functions as F

from affinity import schemas as s
from affinity.operators import content, factors, sgd
from affinity.plans import jobs
from affinity.sources import files
from affinity.sources.tables import Tables
from affinity.streaming import ratings as stream


def test_csv(spark, tmp_path):
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n1,"American President, The (1995)",Comedy\n2,"He said ""hi"" (2000)",Drama\n')
    rows = files.scan_csv(spark, str(tmp_path / "movies.csv"), s.ITEMS_CSV).orderBy("movieId").collect()
    assert [r.title for r in rows] == ["American President, The (1995)", 'He said "hi" (2000)']
    links = files.scan_optional_csv(spark, None, s.LINKS_CSV)
    assert links.columns == ["movieId", "imdbId", "tmdbId"] and links.count() == 0


def test_missing_columns(spark):
    items, ratings = spark.createDataFrame([], s.ITEMS_CSV), spark.createDataFrame([], s.RATINGS_CSV)
    files.validate_schema(items, ratings)
    with pytest.raises(ValueError, match="items lack genres"):
        files.validate_schema(items.drop("genres"), ratings)


def test_enrichment(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"tmdb_id":"7","status":200,"poster_path":"/p","overview":"O","credits":{"crew":[{"name":"A","job":"Writer"},{"name":"B","job":"Director"},{"name":"C","job":"Director"},{"name":"D","job":"Director"}],"cast":[{"name":"1"},{"name":"2"},{"name":"3"},{"name":"4"},{"name":"5"},{"name":"6"}]}}\n'
        '{"tmdb_id":"8","status":404}\n{"tmdb_id":"9","status":200,"credits":{"crew":[],"cast":[]}}\n'
        '{"tmdb_id":"7","status":404}\n{"tmdb_id":"8","status":404}\n'  # several documents of one id
    )
    items = spark.createDataFrame([(1, "7", None), (2, "8", None), (3, "9", None), (4, "nan", None), (5, None, None), (6, "", None), (7, "11", "/x")], "id long, tmdb_id string, poster_path string")
    assert sorted(r.id for r in files.enrich_pending(items).collect()) == [1, 2, 3]
    assert [r.id for r in files.enrich_pending(items, 2).collect()] == [1, 2]
    details = files.details_of(spark.read.schema(s.DETAILS_JSON).json(str(tmp_path / "d.json")))
    assert files.enrich_metadata(items, details).count() == items.count()
    got = {r.id: r for r in files.enrich_metadata(items, details).collect()}
    assert (got[1].director, got[1].cast_list, got[1].poster_path) == ("B, C", "1, 2, 3, 4, 5", "/p")
    assert (got[2].poster_path, got[2].overview) == ("", "")
    assert got[3].director is None and got[7].poster_path == "/x"
    assert files.enrich_pending(files.enrich_metadata(items, details)).where("id = 2").count() == 0


def test_discover(spark):
    feed = spark.createDataFrame(
        [(10, "New", "2020-05-01", 3.456, 8.0, "fr", [28, 1, 35], ""), (10, "New", "2020-05-01", 3.0, 8.0, "fr", [28], ""), (11, None, "2020-06-01", None, None, None, None, ""), (12, "Old", "2019-01-01", 9.0, 1.0, "en", [18], ""), (13, "Known", "2020-01-01", 9.0, 1.0, "en", [18], "")],
        s.DISCOVER_JSON,
    )
    got = files.import_discover(spark.createDataFrame([(40, "13")], "id long, tmdb_id string"), feed, 2020, 2021).orderBy("id").collect()
    assert [(r.id, r.title, r.genres, r.popularity_score, r.trending_score) for r in got] == [(41, "New (2020)", "Action|Comedy", 3.46, 5.53), (42, "Untitled (2020)", "Drama", 10.0, 14.0)]


def test_rejected_lines_are_kept_with_reasons(spark, tmp_path):
    lines = ["1,2,3.5,100", "1,3", "1,4,four,100", '1,"5,3.0,100', "1,6,3.0,100,extra", ",7,3.0,100", "1,8,,100", "1,9,5.5,100", "1,10,0.5,", '"1","11","4.0","7"']
    for k in range(2):
        (tmp_path / f"r{k}.csv").write_text("\n".join(["userId,movieId,rating,timestamp", *lines[k::2]]) + "\n")
    good, bad = files.scan_csv_checked(spark, str(tmp_path), s.RATINGS_CSV, ["userId", "movieId", "rating"], F.col("rating").between(0.5, 5))
    assert {r.movieId for r in good.collect()} == {2, 10, 11}
    got = {r.line: r.reason for r in bad.collect()}
    assert {x: got.pop(x) for x in lines[1:5]} == dict.fromkeys(lines[1:5], "malformed")
    assert sorted(got.values()) == ["missing", "missing", "unsound"]
    assert good.count() + bad.count() == len(lines)


def test_stream_is_idempotent(spark, tmp_path):
    schema = "user_id long, item_id long, rating double, ts long"
    for k, rows in enumerate([[(1, 1, 3.0, 1), (1, 2, 4.0, 1)], [(1, 1, 5.0, 2), (2, 1, 1.0, 2), (2, 77, 1.0, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    items = spark.createDataFrame([(1,), (2,)], "id long")
    for _ in range(2):
        stream.upsert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), items, ["ts"])
    got = {(r.user_id, r.item_id): r.rating for r in stream.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, 1): 5.0, (1, 2): 4.0, (2, 1): 1.0}
    written = [{r.user_id for r in spark.read.parquet(str(tmp_path / "out" / f"delta-{k}")).collect()} for k in range(2)]
    assert sorted(map(sorted, written)) == [[1], [1, 2]]  # a batch writes its own changes only
    assert stream.latest(spark, str(tmp_path / "none")) is None


def test_snapshot_is_merged_and_cleared(spark, tmp_path, monkeypatch):
    """Deltas are merged into a base with more buckets as rows grow, files that are replaced
    go, a batch that is run again changes nothing, and a read for users prunes buckets."""
    monkeypatch.setattr(stream, "DELTAS", 2)
    monkeypatch.setattr(stream, "ROWS", 10)
    out, want = str(tmp_path / "out"), {}
    items = spark.range(5).withColumnRenamed("id", "id")
    for number in range(7):
        rows = [(u, i, float((u * 7 + i * number) % 5), number * 10 + i) for u in range(number * 2, number * 2 + 9) for i in (0, 3, 9)]
        want |= {(u, i): r for u, i, r, _ in rows if i < 5}
        batch = spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long")
        for _ in range(2):
            stream.apply_batch(batch, number, out, items, ["ts"])
        assert {(r.user_id, r.item_id): r.rating for r in stream.latest(spark, out).collect()} == want
    held = stream.manifest(spark, out)
    assert (held["batch"], held["base"], held["buckets"], held["deltas"]) == (6, "base-5", -(-2 * 19 // 10), ["delta-6"])
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == ["base-5", "delta-6", "manifests"]
    few = stream.latest(spark, out, [3, 14])
    assert {(r.user_id, r.item_id) for r in few.collect()} == {k for k in want if k[0] in (3, 14)}
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", few._jdf.queryExecution().toString())
    # A delta whose manifest was never written isn't read.
    spark.createDataFrame([(1, 1, 9.0, 999)], "user_id long, item_id long, rating double, ts long").write.parquet(f"{out}/delta-7")
    assert stream.latest(spark, out).where("rating = 9").count() == 0


def test_model_beats_the_mean_and_is_kept(spark, tmp_path):
    r = random.Random(3)
    u = [[r.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    v = [[r.gauss(0, 1) for _ in range(3)] for _ in range(50)]
    rows = [(i, j, max(0.5, min(5.0, 3 + 0.7 * sum(a * b for a, b in zip(u[i], v[j])) + r.gauss(0, 0.1)))) for i in range(60) for j in range(50) if r.random() < 0.6]
    split = factors.split_ratings(spark.createDataFrame(rows, "user_id long, item_id long, rating double"))
    train, test = split.where("is_train").drop("is_train"), split.where("not is_train").drop("is_train")
    assert 0.7 < train.count() / len(rows) < 0.9
    model = factors.fit_factors(train, rank=8, n_epochs=60, rate=0.05, decay=0.98, reg=0.02)
    error = factors.rmse_mae(factors.predict(test, model)).first().rmse
    spread = test.agg(F.stddev("rating")).first()[0]
    assert error < 0.5 * spread
    als = factors.fit_als(train, rank=3, rounds=8, reg=0.05)
    assert error < 1.05 * factors.rmse_mae(factors.predict(test, als)).first().rmse
    assert factors.load_model(spark, str(tmp_path / "m")) is None
    factors.save_model(model, str(tmp_path / "m"))
    again = factors.load_model(spark, str(tmp_path / "m"))
    assert factors.rmse_mae(factors.predict(test, again)).first().rmse == pytest.approx(error)


def test_blocks_large_ids_and_epochs_counted_once(spark, monkeypatch):
    """Over several blocks, with ids above 2^31, gradient descent beats the mean; an epoch is never
    computed twice, and a stop restores the best one."""
    r = random.Random(5)
    u, v = ([[r.gauss(0, 1) for _ in range(2)] for _ in range(n)] for n in (50, 40))
    big = 3_000_000_000
    rows = [(big + i * big, j * big, 3 + 0.6 * sum(a * b for a, b in zip(u[i], v[j]))) for i in range(50) for j in range(40) if r.random() < 0.6] + [(None, 1, 3.0), (1, 1, None)]
    split = factors.split_ratings(spark.createDataFrame(rows, "user_id long, item_id long, rating double"))
    train, test = split.where("is_train").drop("is_train").cache(), split.where("not is_train").drop("is_train").where("user_id is not null").cache()
    options = dict(rank=4, rate=0.06, decay=1.0, reg=0.02)
    monkeypatch.setattr(sgd, "SIDE", 20)
    training = sgd.start(train, sgd.Options(**options))
    assert training.blocks == 3
    model = sgd.model(sgd.epochs(sgd.epochs(training, 2), 1))
    twice = sgd.model(sgd.epochs(training, 3))
    rows_of = lambda m: sorted((x.item_id, x.bias, tuple(x.features)) for x in m["items"].collect())
    assert rows_of(model) == rows_of(twice) and len(rows_of(model)) == 40
    monkeypatch.setattr(sgd, "SIDE", 500)
    seen, real, errors = [], sgd.epochs, iter([0.9, 0.5, 0.7, 0.8, 0.6, 0.1])
    monkeypatch.setattr(sgd, "epochs", lambda t, n=1: seen.extend(range(t.epoch, t.epoch + n)) or real(t, n))
    measured = factors.rmse_mae
    monkeypatch.setattr(factors, "rmse_mae", lambda _: spark.createDataFrame([(next(errors),)], "rmse double"))
    best, found = factors.fit_early_stop(train, test, n_epochs=6, patience=3, **options)
    assert found == [0.9, 0.5, 0.7, 0.8, 0.6] and seen == [0, 1, 2, 3, 4]
    assert rows_of(best) == rows_of(sgd.model(real(sgd.start(train, sgd.Options(**options)), 2)))
    long = factors.fit_factors(train, n_epochs=120, **options)
    assert measured(factors.predict(test, long)).first().rmse < 0.6 * test.agg(F.stddev("rating")).first()[0]


def test_seed_once(spark, tmp_path):
    jobs.seed(spark.range(3), str(tmp_path / "t"))
    jobs.seed(spark.range(9), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_overviews_are_whole_texts(spark, tmp_path):
    text = "word " * 200 + "lastword"
    spark.createDataFrame([(k, text) for k in range(2)], "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, "red blue", "SMALL", 5, "B") for k in range(1, 3)], "p_partkey long, p_name string, p_type string, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "S")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    items = Tables(spark, str(tmp_path)).items()
    assert [r.overview for r in items.collect()] == [text] * 2
    terms = content.term_counts(items.select(F.col("id").alias("item_id"), F.lower("overview").alias("text")))
    assert {(r.item_id, r.tf) for r in terms.where("term = 'lastword'").collect()} == {(2, 1), (3, 1)}


def test_evaluation_ranks_hybrid_lists(spark, monkeypatch):
    ratings = spark.createDataFrame([(1, i, 5.0) for i in range(1, 21)], "user_id long, item_id long, rating double").withColumn("ts", F.lit("2001-01-01").cast("timestamp"))
    items = spark.createDataFrame([(i, "A", 1.0) for i in range(1, 41)], "id long, genres string, popularity_score double")
    zero = F.array(F.lit(0.0))
    fixed = {
        "mean": spark.createDataFrame([(3.0,)], "mean double"),
        "users": spark.createDataFrame([(1,)], "user_id long").select("user_id", zero.alias("features"), F.lit(0.0).alias("bias")),
        "items": items.select(F.col("id").alias("item_id"), zero.alias("features"), F.lit(0.0).alias("bias")),
    }
    monkeypatch.setattr(factors, "fit_factors", lambda *_: fixed)  # every prediction is 3
    # Items 1 to 20 (rated) and 31 to 40 share a term, 21 to 30 have another.
    weights = items.select(F.col("id").alias("item_id"), F.when(F.col("id").between(21, 30), "b").otherwise("a").alias("term"), F.lit(1.0).alias("w"))
    seen = {}
    monkeypatch.setattr(jobs, "metrics_of", lambda recs, train, test, items: seen.update(recs=recs, test=test) or recs.agg(F.count("*").alias("n")))
    jobs.train_and_evaluate(items, ratings, weights=weights)
    held = {r.item_id for r in seen["test"].collect()}
    got = [r.item_id for r in seen["recs"].orderBy("rank").collect()]
    assert held and got == sorted(held | set(range(31, 41)))[:10]


def test_kept_frames_use_the_folder_given_to_the_context(spark, tmp_path):
    """Where the setting is empty; the setting of a running session can't be changed, so it is stood in for."""
    from types import SimpleNamespace

    from affinity.operators import kept

    session = lambda named: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=spark.sparkContext)
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        assert str(tmp_path) in kept.work_path(session(""), "x")
        assert kept.work_path(session("/named"), "x").startswith("/named/x-")
    finally:
        if before.isDefined():
            spark.sparkContext.setCheckpointDir(before.get())


def test_factors_lie_in_rows_of_bounded_size(spark, monkeypatch):
    """A row holds at most ``PIECE`` ids however many a block has, and when factors are kept doesn't change them."""
    rows = [(i, j, float((i * j) % 9) / 2 + 0.5) for i in range(3000) for j in (i % 60, (i * 7 + 1) % 60)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    monkeypatch.setattr(sgd, "CELL", 2000)
    made = []
    for turns in (8, 1):
        monkeypatch.setattr(sgd, "TURNS", turns)
        training = sgd.epochs(sgd.start(ratings, sgd.Options(rank=3)), 1)
        sizes = training.state.select("kind", F.size("ids").alias("n"), F.length("features").alias("bytes")).collect()
        assert training.blocks == 2 and max(x.n for x in sizes) <= 1024 < max(sum(x.n for x in sizes if x.kind == k) for k in ("user", "item")) / 2
        assert all(x.bytes == 24 * x.n for x in sizes) and sum(x.n for x in sizes) == 3060
        made.append(sorted((x.user_id, x.bias, tuple(x.features)) for x in sgd.model(training)["users"].collect()))
    assert made[0] == made[1]
