"""Ratings, watchlists, kept recommendation lists, and per-user summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as s
from .catalog import user_rows
from .kept import keep, read_if_there

KEY = ["user_id", "item_id"]


def valid_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.where(F.col("rating").between(s.RATING_LOW, s.RATING_HIGH))


def rejected_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.where(~F.coalesce(F.col("rating").between(s.RATING_LOW, s.RATING_HIGH), F.lit(False)))


def rating_upsert(existing: DataFrame, changes: DataFrame, items: DataFrame, order: list[str]) -> DataFrame:
    """Ratings after the changes: of each user and item the last by ``order``; changes
    to unknown items are left out."""
    known = changes.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi").select(existing.columns)
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in order]))
    return existing.unionByName(known).withColumn("n", last).where("n = 1").drop("n")


def watchlist_add(existing: DataFrame, requests: DataFrame, items: DataFrame) -> DataFrame:
    """The watchlist with the requested items that exist and aren't on it yet."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("added_at"))
    fresh = (
        requests.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
        .join(existing, KEY, "left_anti")
        .withColumn("n", first)
        .where("n = 1")
    )
    return existing.unionByName(fresh.select(existing.columns))


def watchlist_remove(existing: DataFrame, removals: DataFrame) -> DataFrame:
    return existing.join(removals, KEY, "left_anti")


def unmatched_removals(existing: DataFrame, removals: DataFrame) -> DataFrame:
    return removals.select(*KEY).distinct().join(existing, KEY, "left_anti")


def watchlist_page(watchlist: DataFrame, items: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    nested = items.select(F.col("id").alias("item_id"), F.struct("id", "title", "genres").alias("item"))
    return user_rows(watchlist.join(nested, "item_id"), "added_at", number, size).select("user_id", "added_at", "n", "item")


def rec_history(recs: DataFrame, kind: str, generated_at: str) -> DataFrame:
    """A history row for each user: the kind, the ids in rank order, and the time."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"])
    return recs.groupBy("user_id").agg(ids.alias("item_ids")).select(
        "user_id", F.lit(kind).alias("recommendation_type"), "item_ids", F.lit(generated_at).cast("timestamp").alias("generated_at")
    )


def append_history(history: DataFrame, path: str) -> None:
    """Add rows to the kept history."""
    history.write.mode("append").parquet(path)


def kept_recs(recs: DataFrame, limit: int, generated_at: str) -> DataFrame:
    """What is kept for later reads: the first 2 * limit of each user."""
    return recs.where(F.col("rank") <= 2 * limit).withColumn("generated_at", F.lit(generated_at).cast("timestamp"))


def read_recs(kept: DataFrame, limit: int, now: str, ttl: int = s.TTL_SECONDS) -> DataFrame:
    """Lists that haven't expired at ``now``, cut to ``limit``."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("generated_at").cast("double")
    return kept.where((F.col("rank") <= limit) & (age < ttl))


def store_recs(recs: DataFrame, path: str, limit: int, generated_at: str, buckets: int) -> None:
    """Keep lists in buckets of users. Buckets that ``recs`` has are replaced, others stay,
    so ``recs`` must hold all lists of its buckets."""
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
    rows = kept_recs(recs, limit, generated_at).withColumns({"buckets": F.lit(buckets), "bucket": bucket})
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(path)


def stored_recs(spark: SparkSession, path: str, users: list[int] | None = None) -> DataFrame | None:
    """The kept lists, or None where there are none; for given users only their buckets."""
    kept = read_if_there(spark, path)
    if kept is None or users is None:
        return kept
    bucket = F.pmod(F.xxhash64("user_id"), F.col("buckets")).cast("int")
    count = kept.select("buckets").first().buckets
    asked = spark.createDataFrame([(u,) for u in users], "user_id long").withColumn("buckets", F.lit(count)).select(bucket.alias("b")).distinct()
    return kept.where(F.col("bucket").isin([r.b for r in asked.collect()]) & F.col("user_id").isin(users))


def expired_users(users: DataFrame, path: str, now: str, buckets: int, ttl: int = s.TTL_SECONDS) -> DataFrame:
    """Those of ``users`` whose bucket has expired at ``now`` or isn't there."""
    spark = users.sparkSession
    kept = read_if_there(spark, path)
    dealt = users.select("user_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    if kept is None:
        return dealt.select("user_id")
    age = F.lit(now).cast("timestamp").cast("double") - F.min("generated_at").cast("double")
    fresh = kept.where(F.col("buckets") == buckets).groupBy("bucket").agg((age < ttl).alias("fresh")).where("fresh")
    return dealt.join(fresh, "bucket", "left_anti").select("user_id")


def refresh_recs(users: DataFrame, lists_of: Callable[[DataFrame], DataFrame], path: str, limit: int, now: str, buckets: int, ttl: int = s.TTL_SECONDS) -> DataFrame:
    """Make lists (``lists_of`` users) anew for the buckets of ``users`` that have expired,
    keep them, and give back whose they are. ``users`` are all users. Buckets
    whose users get no list are tried again each time."""
    stale = keep(expired_users(users, path, now, buckets, ttl), "stale")
    if not stale.isEmpty():
        store_recs(lists_of(stale), path, limit, now, buckets)
    return stale


def rating_insights(ratings: DataFrame) -> DataFrame:
    recent = user_rows(ratings, "ts", size=s.HISTORY_ROWS)
    return recent.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg("rating"), 1).alias("average"), F.max("rating").alias("highest"), F.min("rating").alias("lowest")
    )


def rating_histogram(ratings: DataFrame) -> DataFrame:
    """Counts of the ten half-star bins; empty bins are kept."""
    spark = ratings.sparkSession
    bins = spark.range(1, 11).select((F.col("id") / 2).alias("bin"))
    counts = ratings.groupBy(F.col("rating").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("ratings"))


def user_top_genres(ratings: DataFrame, items: DataFrame) -> DataFrame:
    liked = user_rows(ratings, "ts", size=s.RECENT_ROWS).where(F.col("rating") >= s.LIKED)
    counts = (
        liked.join(items.select(F.col("id").alias("item_id"), "genres"), "item_id")
        .select("user_id", F.explode(F.split("genres", r"\|")).alias("genre"))
        .where((F.trim("genre") != "") & (F.col("genre") != s.NO_GENRES))
        .groupBy("user_id", "genre")
        .agg(F.count(F.lit(1)).alias("liked"))
    )
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("liked"), "genre"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= s.TOP_GENRES)
