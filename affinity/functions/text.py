"""Scalar rules on titles, links, tags and delimited strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as s

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_title(title: C) -> Column:
    """Lower case, without a trailing ``(yyyy)`` and without punctuation."""
    bare = F.regexp_replace(col(title), r"\s*\(\d{4}\)\s*$", "")
    return F.trim(F.lower(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", "")))


def release_year(title: C) -> Column:
    """Year in parentheses at the end, or null."""
    return F.nullif(F.regexp_extract(F.trim(col(title)), r"\((\d{4})\)$", 1), F.lit("")).cast("int")


def decade_token(title: C) -> Column:
    """``decade_1990s`` of the first ``(yyyy)``, or ''."""
    year = F.nullif(F.regexp_extract(col(title), r"\((\d{4})\)", 1), F.lit(""))
    return F.when(year.isNull(), F.lit("")).otherwise(F.concat(F.lit("decade_"), F.substring(year, 1, 3), F.lit("0s")))


def imdb_id(raw: C) -> Column:
    """Without ``.0``, zero-padded to seven and never cut; missing stays null."""
    bare = F.regexp_replace(col(raw), r"\.0$", "")
    return F.lpad(bare, F.greatest(F.lit(7), F.length(bare)), F.lit("0"))


def tmdb_id(raw: C) -> Column:
    return F.regexp_replace(col(raw), r"\.0$", "")


def normal_tag(tag: C) -> Column:
    return F.lower(F.trim(col(tag)))


def image_url(base: str, path: C) -> Column:
    return F.when(F.length(col(path)) > 0, F.concat(F.lit(base), col(path)))


def delimited(text: C, pattern: str) -> Column:
    """Distinct trimmed, lower-cased parts that aren't blank."""
    return F.array_distinct(F.filter(F.transform(F.split(col(text), pattern), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty or missing."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(F.lit(0.0))


def feature_text(tags: C | None = None) -> Column:
    """The item's document: weighted channels at single spaces, blank ones left out."""
    genres = F.when(F.col("genres") != s.NO_GENRES, F.translate("genres", "|", " "))
    director = F.nullif(clean_title("director"), F.lit(""))
    channels = [
        genres, genres, genres,
        clean_title("title"),
        F.lower("overview"),
        director, director,
        clean_title("cast_list"),
        F.lower(col(tags)) if tags is not None else F.lit(None).cast("string"),
        decade_token("title"),
        F.when(F.col("original_language") != "en", F.concat(F.lit("lang_"), F.col("original_language"))),
    ]
    return F.concat_ws(" ", *[F.when(F.trim(c) != "", c) for c in channels])


def normalized_prediction(p: C) -> Column:
    return (col(p) - s.RATING_LOW) / (s.RATING_HIGH - s.RATING_LOW)


def clipped(p: C) -> Column:
    return F.least(F.greatest(col(p), F.lit(s.RATING_LOW)), F.lit(s.RATING_HIGH))


def match_percent(similarity: C) -> Column:
    return F.when(col(similarity) > 0, F.round(col(similarity) * 100).cast("int"))


def dominant_signal(rating_weight: C, content_weight: C) -> Column:
    return F.when(col(rating_weight) > col(content_weight), "collaborative").otherwise("content")


def exact_sum(a: C) -> Column:
    """Sum of an array, with what each addition has lost added back."""

    def add(acc: Column, x: Column) -> Column:
        y = x - acc["lost"]
        total = acc["total"] + y
        return F.struct(total.alias("total"), ((total - acc["total"]) - y).alias("lost"))

    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))
    return F.aggregate(col(a), zero, add)["total"]


def dot(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: C) -> Column:
    return F.sqrt(dot(a, a))


def user_bucket(*keys: C) -> Column:
    """First 32 bits of the MD5 of keys joined by ':', a stable random number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint")
