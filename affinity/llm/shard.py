"""Balanced contiguous shards by byte size (operator 6, DataFrame functions only).

Rows are put in one total order and cut into key ranges; per-range totals give
each range's starting byte, a running sum inside a range gives each row's, and a
row belongs to the shard whose equal target holds the middle of its bytes. Only
the table of range totals is summed in one task; its length is the number of
ranges, not of rows.

Order: doc_id (nulls first), then size, then text checksum. Rows equal in all
three are alike and may swap. Null text has no bytes: size 1, checksum 0 (that
of no bytes). Repeated ids are rows of their own. An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, table


def byte_shards(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = prepare(docs.sparkSession)
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "size", "text_crc32"]
    # The range of a row must not change between readings, so it is kept.
    kept = sized.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()).checkpoint()

    totals = kept.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        kept.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("row", F.count(F.lit(1)).over(inside))
        .join(F.broadcast(starts), "range")  # one row a range
        .withColumn("middle_x2", 2 * (F.col("bytes_before") + F.col("begin")) + F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("row"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"({shards} * middle_x2) div (2 * all_bytes)")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row a shard
        *order[:1],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark, sf_dir):
    return byte_shards(table(spark, sf_dir, "documents"))


#: CRC-32 by its defining table (reflected polynomial 0xEDB88320), folded over the bytes.
SQL = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM (SELECT CAST(unnest(range(256)) AS UBIGINT) AS i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
    CAST(xor(4294967295::UBIGINT, list_reduce(
      list_concat([4294967295::UBIGINT],
        list_transform(regexp_extract_all(h, '..'), lambda x: CAST(concat('0x', x) AS UBIGINT))),
      lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) + 1 AS BIGINT)]))) AS BIGINT) AS text_crc32
  FROM hexed, crc
), summed AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
    CAST(sum(size) OVER () AS BIGINT) AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS n FROM sized
), placed AS (
  SELECT *, CAST(least(7, (8 * (2 * upto - size)) // (2 * total)) AS INT) AS shard FROM summed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM placed
"""
