"""Biased matrix factorisation: splits, baselines, fits, predictions, early stopping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as s
from ..functions.text import clipped, dot, user_bucket
from . import balls, sgd, tiles
from .content import rank_by
from .kept import discard, read_if_there, workers_find_package

DAMPING = 5.0
#: Rows of a block of items that is scored against users; the most of a side of a tile, and tiles
#: from which sides grow; rows of a tile scored at a time.
BLOCK, SIDE, TILES, ROWS = 4096, 1 << 16, 64, 256
#: Share of a tile's pairs of rows up to which pairs of different rows are scored instead; cells of such rows expanded at a time.
ALIKE, EXPANDED = 0.25, 1 << 22


def split_ratings(ratings: DataFrame, train_pct: int = 80) -> DataFrame:
    """With ``is_train``, by a stable hash of user and item."""
    return ratings.withColumn("is_train", user_bucket("user_id", "item_id") % 100 < train_pct)


def sample_ratings(ratings: DataFrame, n: int) -> DataFrame:
    """n ratings by the order of a stable hash; a share little above n is hashed into
    the sort, so the whole table isn't sorted."""
    key = F.md5(F.concat_ws(":", "user_id", "item_id"))
    total = ratings.count()
    share = min(1.0, 1.1 * n / max(1, total))
    return ratings.withColumn("key", key).where(user_bucket("user_id", "item_id") < int(share * 2**32)).orderBy("key").limit(n)


def bias_baseline(ratings: DataFrame, damping: float = DAMPING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean (one row), item biases and user biases, damped towards 0."""
    mean = ratings.agg(F.avg("rating").alias("mean"))
    centred = ratings.crossJoin(F.broadcast(mean)).withColumn("d", F.col("rating") - F.col("mean"))  # one row
    items = centred.groupBy("item_id").agg((F.sum("d") / (damping + F.count(F.lit(1)))).alias("item_bias"))
    users = centred.join(items, "item_id").groupBy("user_id").agg((F.sum(F.col("d") - F.col("item_bias")) / (damping + F.count(F.lit(1)))).alias("user_bias"))
    return mean, items, users


def fit_factors(ratings: DataFrame, rank: int = 100, n_epochs: int = 20, **options) -> dict[str, DataFrame]:
    """Mean, and (user_id | item_id, features, bias), by gradient descent (``sgd.Options``)."""
    return sgd.model(sgd.epochs(sgd.start(ratings, sgd.Options(rank=rank, **options)), n_epochs))


def fit_als(ratings: DataFrame, rank: int = 16, rounds: int = 8, reg: float = 0.1, seed: int = 42) -> dict[str, DataFrame]:
    """The same by ALS on what the damped biases leave; ids must fit 32 bits."""
    mean, items, users = bias_baseline(ratings)
    left = F.col("rating") - F.col("mean") - F.col("item_bias") - F.col("user_bias")
    rest = ratings.crossJoin(F.broadcast(mean)).join(items, "item_id").join(users, "user_id").select("user_id", "item_id", left.cast("float").alias("rating"))  # one row
    als = ALS(rank=rank, maxIter=rounds, regParam=reg, seed=seed, userCol="user_id", itemCol="item_id", ratingCol="rating", coldStartStrategy="nan")
    model = als.fit(rest)

    def side(factors: DataFrame, bias: DataFrame, key: str, name: str) -> DataFrame:
        return bias.join(factors.select(F.col("id").cast("long").alias(key), F.transform("features", lambda x: x.cast("double")).alias("features")), key, "left").select(key, "features", F.col(name).alias("bias"))

    return {"mean": mean, "users": side(model.userFactors, users, "user_id", "user_bias"), "items": side(model.itemFactors, items, "item_id", "item_bias")}


def fit_early_stop(train: DataFrame, valid: DataFrame, n_epochs: int = 20, patience: int = 3, **options) -> tuple[dict[str, DataFrame], list[float]]:
    """The model and the validation error after each epoch. Training goes on from the kept
    factors of the epoch before; after ``patience`` epochs without a new least error it stops, and
    the epoch with the least error counts, else the last one."""
    training = sgd.start(train, sgd.Options(**options))
    best, errors = training, []
    for _ in range(n_epochs):
        before, training = training, sgd.epochs(training)
        errors.append(rmse_mae(predict(valid, sgd.model(training))).first()["rmse"])
        least = errors.index(min(errors)) + 1
        if least == len(errors):
            if best is not before:
                discard(best.state)
            best = training
        if before is not best:
            discard(before.state)
        if len(errors) - least >= patience:
            return sgd.model(best), errors
    return sgd.model(training), errors


def rating_of(mean: str, user_bias: str, item_bias: str, p: str, q: str) -> Column:
    """Prediction: of mean and biases where one side is unknown, and clipped where both
    are known."""
    both = F.col(user_bias).isNotNull() & F.col(item_bias).isNotNull()
    base = F.col(mean) + F.coalesce(user_bias, F.lit(0.0)) + F.coalesce(item_bias, F.lit(0.0))
    return F.when(both, clipped(base + F.coalesce(dot(p, q), F.lit(0.0)))).otherwise(base)


def predict(pairs: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """Pairs with ``prediction``."""
    users = model["users"].select("user_id", F.col("features").alias("p"), F.col("bias").alias("user_bias"))
    items = model["items"].select("item_id", F.col("features").alias("q"), F.col("bias").alias("item_bias"))
    joined = pairs.join(users, "user_id", "left").join(items, "item_id", "left").crossJoin(F.broadcast(model["mean"]))  # one row
    return joined.select(*pairs.columns, rating_of("mean", "user_bias", "item_bias", "p", "q").alias("prediction"))


def candidates(users: DataFrame, items: DataFrame) -> DataFrame:
    """Every user with every item, in blocks of items: each user meets each block by an
    equal key, and one block at a time is in memory."""
    n = items.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    return users.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).join(dealt, "block").drop("block")


def candidate_sums(users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, items, ids): number and sum of the item ids that ``candidates`` has for each
    user. Every user meets the same items, so these are summed before they meet users."""
    whole = items.agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("s")).where("n > 0")
    each = users.groupBy("user_id").agg(F.count(F.lit(1)).alias("times"))
    return each.crossJoin(F.broadcast(whole)).select("user_id", (F.col("times") * F.col("n")).alias("items"), (F.col("times") * F.col("s")).alias("ids"))  # one row


def tile_side(left: int, right: int) -> int:
    """Rows of a side of a tile. All pairs of rows are scored whatever it is, but each row is sent to as
    many tiles as the other table has sides: sides are as long as memory allows and enough tiles are left."""
    return min(SIDE, max(BLOCK, math.isqrt(left * right // TILES)))


def deal_by(rows: DataFrame, key: str) -> Column:
    """What rows (features, bias) are dealt to sides of tiles by: themselves, or their key where one side would get too many."""
    own = F.xxhash64("features", "bias")
    most = rows.groupBy(own.alias("own")).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return own if most <= SIDE // 8 else F.xxhash64(key)


def alike(x: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of equal rows, and for each row the place of its own among them."""
    whole = np.ascontiguousarray(np.column_stack([x, bias]))
    _, first, kind = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * whole.itemsize))).ravel(), return_index=True, return_inverse=True)
    return first, kind


def best_of_kinds(p: np.ndarray, base: np.ndarray, kind: np.ndarray, q: np.ndarray, bias: np.ndarray, of: np.ndarray, clip: tuple[float, float], row: np.ndarray, item: np.ndarray, ids: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places among them, items, values): the n best of each row, where row k has vector ``p[kind[k]]`` and item j has ``q[of[j]]``,
    without the pairs (row, item). Rows of one kind share a list that is as much longer as one of them has pairs."""
    hidden = np.sort(row * len(of) + item)
    least, members = np.bincount(row, minlength=len(kind)), np.argsort(kind, kind="stable")
    upto = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=len(p)))])
    step = max(1, EXPANDED // len(of))
    for i in range(0, len(p), step):
        value = np.clip(base[i : i + step, None] + p[i : i + step] @ q.T + bias, *clip)
        value = np.where(np.isnan(value), -np.inf, np.round(value, 6))[:, of]
        rows = members[upto[i] : upto[min(i + step, len(p))]]
        r, c = tiles.best(value, ids, n + int(least[rows].max(initial=0)), -np.inf)  # by kind, in order
        size = np.bincount(r, minlength=len(value))
        first, own = np.cumsum(size) - size, kind[rows] - i
        each = np.repeat(np.arange(len(rows)), size[own])
        at = np.repeat(first[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(len(each))
        asked = rows[each] * len(of) + c[at]
        place = np.searchsorted(hidden, asked)
        open_ = np.ones(len(asked), bool) if not len(hidden) else hidden[np.minimum(place, len(hidden) - 1)] != asked
        each, at = each[open_], at[open_]
        begin = np.searchsorted(each, np.arange(len(rows)))
        chosen = np.arange(len(each)) - begin[each] < n
        each, at = each[chosen], at[chosen]
        yield rows, each, c[at], value[r[at], c[at]]


def best_in_blocks(left: DataFrame, items: DataFrame, seen: DataFrame, n: int, mean: float, clip: tuple[float, float], name: str, unit: bool = False) -> DataFrame:
    """(id, item_id, score): for each row of ``left`` (id, features, bias) the n best of
    each block of ``items`` (item_id, features, bias) by mean + biases + inner product (of
    unit vectors if ``unit``), clipped, without the pairs (id, item_id) in ``seen``. A task
    takes about ``tile_side`` rows of both sides, in which ``balls`` skips what can't be among the best, so
    that pairs are never shuffled. Rows with equal vectors and biases come to the same tiles and are scored once, unless they are too many for one side. Equal scores (at six places) go by item_id; scores
    that aren't numbers are left out."""
    workers_find_package(left.sparkSession)
    sizes = [df.count() for df in (items, left)]
    blocks, chunks = (max(1, -(-n // tile_side(*sizes))) for n in sizes)
    items, left = (df.select("*", F.pmod(deal_by(df, key), F.lit(k)).cast("int").alias(c)) for df, key, k, c in ((items, "item_id", blocks, "block"), (left, "id", chunks, "chunk")))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    missed = seen.join(items.select("item_id", "block"), "item_id").groupBy("id", "block").agg(F.collect_set("item_id").alias("seen"))  # a side at most
    asked = left.select("id", F.col("features").alias("p"), F.col("bias").alias("a"), "chunk", every(blocks).alias("block")).join(missed, ["id", "block"], "left")
    held = items.select("item_id", F.col("features").alias("q"), F.col("bias").alias("b"), "block", every(chunks).alias("chunk"))

    def best(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(other):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "item_id": pd.Series(dtype="int64"), name: pd.Series(dtype="float64")})
        other = other.sort_values("item_id")
        ids, who, out = other["item_id"].to_numpy(np.int64), own["id"].to_numpy(np.int64), []
        width = max((len(x) for part in (own["p"], other["q"]) for x in part if x is not None), default=0)
        stack = lambda part: np.stack([np.zeros(width) if x is None else np.asarray(x, np.float64) for x in part])
        p, q, base, bias = stack(own["p"]), stack(other["q"]), mean + own["a"].to_numpy(np.float64), other["b"].to_numpy(np.float64)
        if unit:
            p, q = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) for x in (p, q))
        (some, kind), (shown, of) = alike(p, base), alike(q, bias)
        if len(some) * len(shown) <= ALIKE * len(p) * len(q):
            gone = [(k, x) for k, x in enumerate(own["seen"]) if x is not None]
            row = np.repeat([k for k, _ in gone], [len(x) for _, x in gone]).astype(np.int64)
            item = np.searchsorted(ids, np.concatenate([x for _, x in gone])) if gone else np.zeros(0, np.int64)
            for i, r, c, value in best_of_kinds(p[some], base[some], kind, q[shown], bias[shown], of, clip, row, item, ids, n):
                out.append(pd.DataFrame({"id": who[i][r], "item_id": ids[c], name: value}))
            return pd.concat(out)
        shown = balls.Balls(q, bias)
        for i in range(0, len(own), ROWS):
            gone = [(k, x) for k, x in enumerate(own["seen"].iloc[i : i + ROWS]) if x is not None]
            row = np.repeat([k for k, _ in gone], [len(x) for _, x in gone]).astype(np.int64)
            item = np.concatenate([x for _, x in gone]) if gone else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(ids, item), len(ids) - 1)
            there = ids[at] == item
            value = shown.scores(p[i : i + ROWS], base[i : i + ROWS], clip, (row[there], at[there]), n)
            r, c = tiles.best(value, ids, n, -np.inf)
            out.append(pd.DataFrame({"id": who[i + r], "item_id": ids[c], name: value[r, c]}))
        return pd.concat(out)

    keys = ["block", "chunk"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(best, f"id long, item_id long, {name} double")


def recommend_collab(model: dict[str, DataFrame], watched: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, prediction, rank): the n best unrated items of the factor table."""
    mean = model["mean"].first()[0]
    users = model["users"].select(F.col("user_id").alias("id"), "features", "bias")
    seen = watched.select(F.col("user_id").alias("id"), "item_id")
    best = best_in_blocks(users, model["items"], seen, n, mean, (s.RATING_LOW, s.RATING_HIGH), "prediction").withColumnRenamed("id", "user_id")
    return top_n(best, "prediction", n)


def top_n(scores: DataFrame, score: str, n: int, key: str = "user_id") -> DataFrame:
    return scores.withColumn("rank", rank_by(key, score)).where(F.col("rank") <= n)


def similar_items_latent(factors: DataFrame, n: int) -> DataFrame:
    """(item_id, other_id, similarity, rank) by cosine of the factors, above 0."""

    items = factors.select("item_id", "features", F.lit(0.0).alias("bias"))
    itself = factors.select(F.col("item_id").alias("id"), "item_id")
    best = best_in_blocks(items.withColumnRenamed("item_id", "id"), items, itself, n, 0.0, (-2.0, 2.0), "similarity", unit=True).where("similarity > 0")
    return top_n(best, "similarity", n, "id").select(F.col("id").alias("item_id"), F.col("item_id").alias("other_id"), "similarity", "rank")


def rmse_mae(predicted: DataFrame) -> DataFrame:
    e = F.col("rating") - F.col("prediction")
    return predicted.agg(F.coalesce(F.sqrt(F.avg(e * e)), F.lit(0.0)).alias("rmse"), F.coalesce(F.avg(F.abs(e)), F.lit(0.0)).alias("mae"))


def save_model(model: dict[str, DataFrame], path: str, weights: DataFrame | None = None) -> None:
    """The tables of the factors and, if given, the TF-IDF weights."""
    for name, df in (model | ({} if weights is None else {"weights": weights})).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark, path: str) -> dict[str, DataFrame] | None:
    """The saved tables, with ``weights`` where they were saved, or None where there is no complete model."""
    tables = {name: read_if_there(spark, f"{path}/{name}") for name in ("mean", "users", "items", "weights")}
    if any(tables[name] is None for name in ("mean", "users", "items")):
        return None
    return {name: df for name, df in tables.items() if df is not None}
