"""A catalog table that prunes by id, trigram posting lists for search, and pages by key.

``write_catalog`` keeps items in order of id, in small row groups with Bloom filters, so a
look-up by id reads one group. ``write_postings`` keeps, for each three letters of the
lower-cased text of a field, the ids that hold them, in order of (field, gram); a row has
the ids of one block of ``BLOCK`` neighbouring ids, so a gram that most items have is many
bounded rows. A search intersects the lists of its grams block by block, reads only
catalog rows with the ids that are left, and tests these exactly.

Texts of one or two letters have no gram and are tested on all rows. Null texts hold
nothing. Rows that share an id are found and tested each. Rows without an id are not in
any list, so they are tested too. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog

BLOCK, GROUP_BYTES = 1 << 16, 8 << 20
#: Up to so many ids are named in the filter of the catalog's scan; more are joined.
NAMED = 1000


def write_catalog(items: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    ordered = items.repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.option("parquet.bloom.filter.enabled#id", "true").option("parquet.block.size", group_bytes).parquet(path)
    return items.sparkSession.read.parquet(path)


def get_item(table: DataFrame, item_id: int) -> DataFrame:
    return table.where(F.col("id") == item_id)


def grams_with_field(field: str) -> Column:
    """(field, gram) of every three letters; none for shorter texts and nulls."""
    low = F.lower(F.col(field))
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    grams = F.when(F.length(low) >= 3, grams).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array_distinct(grams), lambda g: F.struct(F.lit(field).alias("field"), g.alias("gram")))


def write_postings(items: DataFrame, path: str, fields: tuple[str, ...] = ("title", "genres"), block: int = BLOCK) -> DataFrame:
    """(field, gram, block, ids)."""
    grams = [grams_with_field(c) for c in fields]
    (
        items.where("id is not null")
        .select("id", F.explode(F.concat(*grams)).alias("g"))
        .groupBy("g.field", "g.gram", F.floor(F.col("id") / block).alias("block"))
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .repartitionByRange("field", "gram", "block").sortWithinPartitions("field", "gram", "block")
        .write.partitionBy("field").parquet(path)
    )
    return items.sparkSession.read.schema("gram string, block long, ids array<long>, field string").parquet(path)


def grams_of(postings: DataFrame, text: str) -> list[str]:
    low = postings.sparkSession.sql("SELECT lower(:text) AS t", {"text": text}).first().t  # as Spark lowers the fields
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def candidates(postings: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame | None:
    """Ids that have all grams of the wanted (field, text); None where there are no grams."""
    grams = {(field, g) for field, text in wanted for g in grams_of(postings, text)}
    if not grams:
        return None
    by_field = {f: [g for x, g in sorted(grams) if x == f] for f, _ in grams}
    one_of = reduce(Column.__or__, [(F.col("field") == f) & F.col("gram").isin(g) for f, g in by_field.items()])
    lists = postings.where(one_of).groupBy("block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(grams))
    both = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), F.array_intersect)
    return lists.select(F.explode(both).alias("id"))


def holding(table: DataFrame, postings: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Rows that can hold the wanted texts; those that do are among them."""
    ids = candidates(postings, [(f, t) for f, t in wanted if t])
    if ids is None:
        return table
    few = [r.id for r in ids.limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return table.where(F.col("id").isin(few) | F.col("id").isNull())
    return table.join(ids, "id", "left_semi").unionByName(table.where("id is null"))


def search_title(table: DataFrame, postings: DataFrame, text: str, genres: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    names = [g.strip() for g in (genres or "").split(",")]
    return catalog.search_title(holding(table, postings, [("title", text), *(("genres", g) for g in names)]), text, genres, number, size)


def filter_genres_all(table: DataFrame, postings: DataFrame, genres: str | None) -> DataFrame:
    names = [g.strip() for g in (genres or "").split(",")]
    return catalog.filter_genres_all(holding(table, postings, [("genres", g) for g in names]), genres)


def filter_year(table: DataFrame, postings: DataFrame, year: str | None) -> DataFrame:
    return catalog.filter_year(holding(table, postings, [("title", f"({year})")]) if year else table, year)


def page_after(rows: DataFrame, sort: str, last: tuple | None = None, descending: bool = True, size: int = 20) -> DataFrame:
    """The page that follows a row with ``last`` (sort value, id), in the order of
    ``catalog.browse``: nulls come last in descending order and first in ascending."""
    if sort not in catalog.SORTS:
        raise ValueError(f"can't sort by {sort}")
    c = F.col(sort)
    if last is not None:
        value, item_id = last
        same = (c.isNull() if value is None else c == F.lit(value)) & (F.col("id") > item_id)
        if value is None:
            beyond = F.lit(False) if descending else c.isNotNull()
        else:
            beyond = (c < F.lit(value)) | c.isNull() if descending else c > F.lit(value)
        rows = rows.where(same | beyond)
    return rows.orderBy(c.desc() if descending else c.asc(), "id").limit(size)
