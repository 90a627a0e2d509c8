"""Catalog queries: filters, search, pages, counts. Every order ends with the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as s

SORTS = ("popularity_score", "trending_score", "title", "vote_average", "release_date")


def like_literal(text: str) -> str:
    """For LIKE patterns: the text itself, with its wildcards escaped."""
    return text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")


def filter_genre(items: DataFrame, genre: str | None) -> DataFrame:
    return items.where(F.col("genres").contains(genre)) if genre else items


def filter_genres_all(items: DataFrame, genres: str | None) -> DataFrame:
    """All of a comma list; blanks are ignored."""
    for g in filter(None, map(str.strip, (genres or "").split(","))):
        items = filter_genre(items, g)
    return items


def filter_language(items: DataFrame, language: str | None) -> DataFrame:
    return items.where(F.col("original_language") == language.lower()) if language else items


def filter_year(items: DataFrame, year: str | None) -> DataFrame:
    return items.where(F.col("title").contains(f"({year})")) if year else items


def page(rows: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    return rows.offset((number - 1) * size).limit(size)


def browse(items: DataFrame, genre=None, genres=None, language=None, year=None, sort: str = "popularity_score", descending: bool = True, number: int = 1, size: int = 20) -> DataFrame:
    if sort not in SORTS:
        raise ValueError(f"can't sort by {sort}")
    rows = filter_year(filter_language(filter_genres_all(filter_genre(items, genre), genres), language), year)
    return page(rows.orderBy(F.col(sort).desc() if descending else F.col(sort).asc(), "id"), number, size)


def search_title(items: DataFrame, text: str, genres=None, number: int = 1, size: int = 20) -> DataFrame:
    rows = filter_genres_all(items.where(F.col("title").ilike(f"%{like_literal(text)}%")), genres)
    return page(rows.orderBy(F.desc("popularity_score"), "id"), number, size)


def page_meta(rows: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("total_items"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_items") / size)).cast("bigint")
    return total.select("total_items", pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def genre_counts(items: DataFrame) -> DataFrame:
    """Items of each genre, in alphabetic order."""
    return (
        items.select(F.explode(F.split("genres", r"\|")).alias("genre"))
        .select(F.trim("genre").alias("genre"))
        .where((F.col("genre") != "") & (F.col("genre") != s.NO_GENRES))
        .groupBy("genre")
        .agg(F.count(F.lit(1)).alias("items"))
        .orderBy("genre")
    )


def table_stats(items: DataFrame, ratings: DataFrame) -> DataFrame:
    usable = F.col("tmdb_id").isNotNull() & ~F.col("tmdb_id").isin("", "nan")
    left = items.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("poster_path").isNotNull()).alias("enriched"),
        F.count_if(usable & F.col("poster_path").isNull()).alias("pending"),
    )
    right = ratings.agg(F.count(F.lit(1)).alias("ratings"))
    return left.crossJoin(F.broadcast(right)).withColumn(  # one row each
        "enriched_pct", F.when(F.col("items") > 0, F.round(F.col("enriched") / F.col("items") * 100, 1)).otherwise(0.0)
    )


def feature_coverage(items: DataFrame, tags: str = "user_tags") -> DataFrame:
    has = lambda c: F.count_if(F.length(F.trim(c)) > 0)
    return items.agg(has("overview").alias("with_overview"), has(tags).alias("with_tags"))


def user_rows(rows: DataFrame, time: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page of every user's rows, newest first."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(time), "item_id"))
    return rows.withColumn("n", at).where(F.col("n").between((number - 1) * size + 1, number * size))
