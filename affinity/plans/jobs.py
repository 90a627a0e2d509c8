"""Jobs over several operators: ingest, training, evaluation, and kept results."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import feature_text
from ..operators import evaluate, factors, recommend, scores
from ..operators.kept import keep, read_if_there


def tagged_items(items: DataFrame, ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """Items with scores and their most frequent tags."""
    best = scores.top_tags(tags)
    return scores.scored_items(items, ratings).join(best, F.col("id") == best["item_id"], "left").drop("item_id")


def item_texts(items: DataFrame, tags: DataFrame) -> DataFrame:
    """(item_id, text) of the items' feature texts. Items are dealt by id before tags come to
    them, and terms are counted where they lie, so that a text is shuffled once."""
    best = scores.top_tags(tags)
    tagged = items.repartition("id").join(best, F.col("id") == best["item_id"], "left")
    return tagged.select(F.col("id").alias("item_id"), feature_text("user_tags").alias("text"))


def seed(df: DataFrame, path: str) -> None:
    """Write only where nothing is yet."""
    df.write.mode("ignore").parquet(path)


def write_metrics(metrics: DataFrame, path: str, began: float | None = None, **facts) -> None:
    """One row as JSON, with the time of training, how long it took since ``began`` (seconds
    since 1970), and other facts."""
    now = time.time()
    facts |= {"trained_at": datetime.fromtimestamp(now, timezone.utc).isoformat(), "training_duration_seconds": round(now - (began or now), 2)}
    metrics.select("*", *[F.lit(v).alias(k) for k, v in facts.items()]).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The last metrics, or None where nothing was trained."""
    return read_if_there(spark, path, "json")


def metrics_of(recs: DataFrame, train: DataFrame, test: DataFrame, items: DataFrame) -> DataFrame:
    """One row of ranking metrics, coverage, diversity and novelty of the users that have
    relevant items in ``test``."""
    recs = keep(evaluate.evaluated(recs, test), "lists")
    parts = [evaluate.catalog_coverage(recs, items), evaluate.intralist_diversity(recs, items), evaluate.novelty(recs, train, items)]
    out = evaluate.rank_metrics(recs, test)
    for p in parts:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def routed_lists(model: dict[str, DataFrame] | None, users: DataFrame, ratings: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, score, rank, kind, message): popular lists for cold users, and for
    all where there is no model; for the others hybrid lists, or lists by prediction (kind
    ``prediction``) where the model has no TF-IDF weights."""
    pop = scores.popularity(ratings).withColumn("popularity_score", F.round("popularity_score", 6))
    popular = recommend.popularity_topn(users, pop, ratings, n)
    if model is None:
        cold = users.select("user_id", F.lit(True).alias("is_cold")).distinct()
        return recommend.route(cold, popular.withColumn("score", F.col("popularity_score")).limit(0), popular)
    weights = model.get("weights")
    lists = factors.recommend_collab(model, ratings, n).withColumnRenamed("prediction", "score") if weights is None else recommend.recommend_hybrid(model, ratings, weights, n)
    return recommend.route(recommend.cold_users(users, ratings, model["users"]), lists, popular, "prediction" if weights is None else "hybrid")


def train_and_evaluate(items: DataFrame, ratings: DataFrame, rank: int = 100, n_epochs: int = 20, weights: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Split, fit, measure on the held-out part, then fit on all ratings. Cold users get
    popular items, from which everything they rated is left out, held-out items too. With
    ``weights`` of the items' texts the others get hybrid lists with profiles of the
    training part, else lists by prediction."""
    split = factors.split_ratings(ratings)
    train, test = split.where("is_train").drop("is_train"), split.where("not is_train").drop("is_train")
    model = factors.fit_factors(train, rank, n_epochs)
    error = factors.rmse_mae(factors.predict(test, model))
    users = test.select("user_id").distinct()
    cold = recommend.cold_users(users, ratings, model["users"])
    popular = recommend.popularity_topn(users, scores.popularity(train), ratings, 10)
    if weights is None:
        warm = factors.recommend_collab(model, evaluate.exclude_set(ratings, test), 10).withColumnRenamed("prediction", "score")
    else:  # what the training part has rated is the exclude set
        warm = recommend.recommend_hybrid(model, train, weights, 10)
    recs = recommend.route(cold, warm, popular, "prediction" if weights is None else "hybrid")
    metrics = metrics_of(recs, train, test, items).crossJoin(F.broadcast(error))  # one row
    return factors.fit_factors(ratings, rank, n_epochs), metrics
