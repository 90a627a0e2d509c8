"""CSV and JSON inputs, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as s
from ..operators.kept import numbered


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def scan_csv_checked(spark: SparkSession, path: str, schema: str, required: list[str], sound: Column | None = None, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (line, reason) of all others: ``malformed`` (too few or too many fields, a
    number that isn't one, a stray quote), ``missing`` (a required column is empty) and ``unsound``
    (the condition ``sound`` doesn't hold). Every line of the files but headers is in one of both."""
    options = {"header": header, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "columnPruning": False, "enforceSchema": True}
    rows = spark.read.schema(schema + ", _line string").options(**options).csv(path)
    names = [c for c in rows.columns if c != "_line"]
    empty = F.greatest(*[F.col(c).isNull().cast("int") for c in [required[0], *required]]) == 1
    reason = F.when(F.col("_line").isNotNull(), "malformed").when(empty, "missing")
    if sound is not None:
        reason = reason.when(~F.coalesce(sound, F.lit(False)), "unsound")
    marked = rows.withColumn("reason", reason)
    line = F.coalesce("_line", F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]))
    return marked.where("reason is null").select(names), marked.where("reason is not null").select(line.alias("line"), "reason")


def scan_optional_csv(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """An empty frame of the schema where there is no file, so that left joins give nulls."""
    return scan_csv(spark, path, schema) if path else spark.createDataFrame([], schema)


def validate_schema(items: DataFrame, ratings: DataFrame) -> None:
    """Raise before any job if required columns are missing."""
    for name, df, need in (("items", items, ("movieId", "title", "genres")), ("ratings", ratings, ("userId", "movieId", "rating"))):
        if missing := [c for c in need if c not in df.columns]:
            raise ValueError(f"{name} lack {', '.join(missing)}")


def details_of(raw: DataFrame) -> DataFrame:
    """Flat columns of detail documents: up to two directors, five of the cast."""
    names = lambda xs, n: F.array_join(F.slice(F.transform(xs, lambda x: x["name"]), 1, n), ", ")
    directors = F.filter("credits.crew", lambda x: x["job"] == "Director")
    return raw.select(
        "tmdb_id", "status", "poster_path", "backdrop_path", "overview", "release_date", "runtime", "vote_average", "original_language", "tagline",
        F.when(F.size(directors) > 0, names(directors, s.DIRECTORS)).alias("director"),
        F.when(F.size("credits.cast") > 0, names(F.col("credits.cast"), s.CAST_NAMES)).alias("cast_list"),
    )


def enrich_metadata(items: DataFrame, details: DataFrame) -> DataFrame:
    """Detail columns written onto the items that were found; not found (404) sets
    overview and poster to '', so that the item is not asked for again. Of several
    documents of one id a found one counts, then the one with the greatest overview."""
    best = F.struct(F.coalesce(F.col("status") == 200, F.lit(False)), F.coalesce("overview", F.lit("")), F.coalesce("poster_path", F.lit("")))
    one = details.groupBy("tmdb_id").agg(F.max_by(F.struct(*[c for c in details.columns if c != "tmdb_id"]), best).alias("d"))
    details = one.select("tmdb_id", "d.*").select(*details.columns)
    d = details.select(*[F.col(c).alias(f"d_{c}") for c in details.columns])
    found, gone = F.col("d_status") == 200, F.col("d_status") == 404

    def column(name: str) -> Column:
        own = F.col(name) if name in items.columns else F.lit(None).cast(details.schema[name].dataType)
        value = F.when(found, F.col(f"d_{name}"))
        if name in ("overview", "poster_path"):
            value = value.when(gone, F.lit(""))
        return value.otherwise(own).alias(name)

    changed = [c for c in details.columns if c not in ("tmdb_id", "status")]
    return items.join(d, items["tmdb_id"] == d["d_tmdb_id"], "left").select(*[c for c in items.columns if c not in changed], *map(column, changed))


def enrich_pending(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items with a usable external id and no poster yet."""
    rows = items.where(F.col("tmdb_id").isNotNull() & ~F.col("tmdb_id").isin("", "nan") & F.col("poster_path").isNull())
    return rows if limit is None else rows.orderBy("id").limit(limit)


def import_discover(items: DataFrame, feed: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """New items of a discover feed, in order of popularity, numbered after the last id."""
    names = F.create_map(*[F.lit(x) for k, v in s.GENRE_NAMES.items() for x in (k, v)])
    genres = F.array_compact(F.transform("genre_ids", lambda g: names[g]))
    year = F.coalesce(F.nullif(F.substring("release_date", 1, 4), F.lit("")), F.lit(str(start_year)))
    pop, vote = F.coalesce("popularity", F.lit(10.0)), F.coalesce("vote_average", F.lit(7.0))
    fresh = (
        feed.where(F.col("release_date").between(f"{start_year}-01-01", f"{end_year}-12-31"))
        .withColumn("tmdb_id", F.col("id").cast("string"))
        .withColumn("n", F.row_number().over(Window.partitionBy("tmdb_id").orderBy(F.desc_nulls_last("popularity"), "title")))
        .where("n = 1")
        .join(items.select("tmdb_id").distinct(), "tmdb_id", "left_anti")
    )
    last = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    return numbered(fresh, [F.desc_nulls_last("popularity"), F.col("tmdb_id")], "place").crossJoin(F.broadcast(last)).select(  # one row
        (F.col("last") + F.col("place")).alias("id"),
        F.concat(F.coalesce("title", F.lit("Untitled")), F.lit(" ("), year, F.lit(")")).alias("title"),
        F.when(F.size(genres) > 0, F.concat_ws("|", genres)).otherwise("Drama").alias("genres"),
        "tmdb_id",
        F.round(pop, 2).alias("popularity_score"),
        F.round(pop * vote / 5, 2).alias("trending_score"),
        "release_date",
        vote.alias("vote_average"),
        F.coalesce("original_language", F.lit("en")).alias("original_language"),
    )
