"""Offline evaluation of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as s
from ..functions.text import delimited, jaccard, user_bucket


def eval_user_sample(test: DataFrame, n: int = 2000) -> DataFrame:
    """At most n test users by a stable hash."""
    return test.select("user_id").distinct().orderBy(user_bucket("user_id"), "user_id").limit(n)


def exclude_set(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """What a user has rated, without the held-out items."""
    return ratings.select("user_id", "item_id").join(test.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def marked_hits(recs: DataFrame, test: DataFrame, k: int = s.TOP_K) -> DataFrame:
    """The first k of each list with hits and their running count."""
    relevant = test.where(F.col("rating") >= s.RELEVANT).select("user_id", "item_id", F.lit(1).alias("r"))
    upto = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = recs.where(F.col("rank") <= k).join(relevant, ["user_id", "item_id"], "left").withColumn("hit", F.coalesce("r", F.lit(0)))
    return marked.select("user_id", "item_id", "rank", "hit", F.sum("hit").over(upto).alias("hits"))


def user_metrics(recs: DataFrame, test: DataFrame, k: int = s.TOP_K) -> DataFrame:
    """Precision, recall, average precision and NDCG of each user with relevant items."""
    relevant = test.where(F.col("rating") >= s.RELEVANT).groupBy("user_id").agg(F.count_distinct("item_id").alias("rel"))
    gains = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.lit(k), F.col("rel").cast("int"))), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda a, x: a + x)
    sums = marked_hits(recs, test, k).groupBy("user_id").agg(
        F.sum("hit").alias("found"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("ap"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return relevant.join(sums, "user_id", "left").select(
        "user_id", (zero("found") / k).alias("precision"), (zero("found") / F.col("rel")).alias("recall"),
        (F.coalesce("ap", F.lit(0.0)) / F.least(F.lit(k), F.col("rel"))).alias("average_precision"), (F.coalesce("dcg", F.lit(0.0)) / gains).alias("ndcg"),
    )


def evaluated(recs: DataFrame, test: DataFrame) -> DataFrame:
    """Lists of the users that are evaluated: those with a relevant item in ``test``."""
    return recs.join(test.where(F.col("rating") >= s.RELEVANT).select("user_id").distinct(), "user_id", "left_semi")


def rank_metrics(recs: DataFrame, test: DataFrame, k: int = s.TOP_K) -> DataFrame:
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    return user_metrics(recs, test, k).agg(F.count(F.lit(1)).alias("users"), mean("precision", "precision_at_k"), mean("recall", "recall_at_k"), mean("average_precision", "map_at_k"), mean("ndcg", "ndcg_at_k"))


def catalog_coverage(recs: DataFrame, items: DataFrame) -> DataFrame:
    shown = recs.agg(F.count_distinct("item_id").alias("shown"))
    return shown.crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("n")))).select(F.round(F.col("shown") / F.col("n"), 6).alias("coverage"))  # one row each


def intralist_diversity(recs: DataFrame, items: DataFrame, k: int = s.TOP_K) -> DataFrame:
    """Mean of 1 - genre Jaccard over the pairs of a list, then over users with a pair."""
    sets = recs.where(F.col("rank") <= k).join(items.select(F.col("id").alias("item_id"), delimited("genres", r"\|").alias("g")), "item_id").select("user_id", "rank", "g")
    whole = sets.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "g"))).alias("x"))  # k sets at most
    later = lambda a: F.transform(F.filter("x", lambda b: b["rank"] > a["rank"]), lambda b: F.struct(a["g"].alias("g"), b["g"].alias("h")))
    pairs = whole.select("user_id", F.inline(F.flatten(F.transform("x", later))))
    each = pairs.groupBy("user_id").agg(F.avg(1 - jaccard(F.col("g"), F.col("h"))).alias("d"))
    return each.agg(F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 6).alias("diversity"))


def novelty(recs: DataFrame, train: DataFrame, items: DataFrame) -> DataFrame:
    """Mean self-information of each list, then over users."""
    counts = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    whole = train.agg(F.count(F.lit(1)).alias("t")).crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("n"))))  # one row each
    joined = recs.join(counts, "item_id", "left").crossJoin(F.broadcast(whole))
    surprise = -F.log2((F.coalesce("c", F.lit(0)) + 1) / (F.greatest("t", F.lit(1)) + F.col("n")))
    return joined.groupBy("user_id").agg(F.avg(surprise).alias("own")).agg(F.round(F.coalesce(F.avg("own"), F.lit(0.0)), 6).alias("novelty"))
