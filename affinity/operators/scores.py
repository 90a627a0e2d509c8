"""Per-item and per-user aggregates of ratings and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as s


def popularity(ratings: DataFrame) -> DataFrame:
    """Average rating times ln(1 + count), of each rated item."""
    score = F.avg("rating") * F.log1p(F.count(F.lit(1)))
    return ratings.groupBy("item_id").agg(score.alias("popularity_score"))


def trending(ratings: DataFrame) -> DataFrame:
    """Like popularity, with weights that halve every year before the newest rating."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    newest = ratings.agg(F.max(seconds).alias("newest"))
    weight = F.pow(F.lit(2.0), -(F.col("newest") - seconds) / s.HALF_LIFE_SECONDS)
    return (
        ratings.crossJoin(F.broadcast(newest))  # one row
        .select("item_id", "rating", weight.alias("w"))
        .groupBy("item_id")
        .agg((F.sum(F.col("rating") * F.col("w")) / F.sum("w") * F.log1p(F.sum("w"))).alias("trending_score"))
    )


def decayed_sums(ratings: DataFrame, sign: int = 1) -> DataFrame:
    """(item_id, n, total, w, rw, at): what both scores need of a batch of ratings, with
    weights that halve every year before ``at``, the item's newest rating (in seconds).
    ``sign`` -1 takes ratings that were replaced out again."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    one = F.lit(float(sign))
    return _summed(ratings.select("item_id", F.lit(sign).cast("long").alias("n"), (one * F.col("rating")).alias("total"), one.alias("w"), (one * F.col("rating")).alias("rw"), seconds.alias("at")))


def merged_sums(sums: DataFrame, batch: DataFrame) -> DataFrame:
    """Sums of both; work follows items, not their history."""
    return _summed(sums.unionByName(batch))


def _summed(parts: DataFrame) -> DataFrame:
    newest = F.max("at").over(Window.partitionBy("item_id"))
    aged = F.pow(F.lit(2.0), -(F.col("newest") - F.col("at")) / s.HALF_LIFE_SECONDS)
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("w") * aged).alias("w"), F.sum(F.col("rw") * aged).alias("rw"), F.max("at").alias("at")]
    return parts.withColumn("newest", newest).groupBy("item_id").agg(*sums)


def scores_of(sums: DataFrame) -> DataFrame:
    """(item_id, popularity_score, trending_score) as ``popularity`` and ``trending`` of all
    ratings in the sums, of items that have any left."""
    rated = sums.where("n > 0")
    newest = rated.agg(F.max("at").alias("newest"))
    weight = F.col("w") * F.pow(F.lit(2.0), -(F.col("newest") - F.col("at")) / s.HALF_LIFE_SECONDS)
    return rated.crossJoin(F.broadcast(newest)).select(  # one row
        "item_id", (F.col("total") / F.col("n") * F.log1p("n")).alias("popularity_score"), (F.col("rw") / F.col("w") * F.log1p(weight)).alias("trending_score")
    )


def scored_items(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """Items with both scores, 0 where unrated."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    both = popularity(ratings).join(trending(ratings), "item_id")
    return items.join(both, items["id"] == both["item_id"], "left").select(*items.columns, zero("popularity_score"), zero("trending_score"))


def top_tags(tags: DataFrame, n: int = s.TOP_TAGS) -> DataFrame:
    """The most frequent tags of each item, joined by spaces."""
    counts = tags.groupBy("item_id", F.lower(F.trim("tag")).alias("tag")).agg(F.count(F.lit(1)).alias("c")).where("tag is not null")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("c"), "tag"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "tag")))
    return (
        counts.withColumn("rank", rank)
        .where(F.col("rank") <= n)
        .groupBy("item_id")
        .agg(F.array_join(F.transform(ordered, lambda x: x["tag"]), " ").alias("user_tags"))
    )


def matrix_stats(ratings: DataFrame) -> DataFrame:
    users, items, n = F.count_distinct("user_id"), F.count_distinct("item_id"), F.count(F.lit(1))
    return ratings.agg(users.alias("users"), items.alias("items"), n.alias("ratings")).withColumn(
        "sparsity_pct", F.round((1 - F.col("ratings") / (F.col("users") * F.col("items"))) * 100, 6)
    )


def rating_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("ratings"))
