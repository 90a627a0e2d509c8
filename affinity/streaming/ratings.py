"""Ratings that arrive as files, applied to a Parquet snapshot.

The snapshot is a base, dealt into buckets of users, and deltas. A batch writes one delta
with the changes that count, and a manifest that names what the snapshot consists of;
readers merge base and deltas, the last change of a user and item by the order of the
stream. After ``DELTAS`` deltas a batch merges them into a new base, whose bucket count
follows its rows, and deletes the files that the new manifest doesn't name. A batch is
done when its manifest is written: running it again before that overwrites its files,
running it again afterwards changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.interactions import KEY
from ..operators.kept import read_if_there

#: Deltas that are merged on read; rows of a bucket.
DELTAS, ROWS = 8, 500_000


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def files_of(rows: int) -> int:
    """An even number of files of at most ``ROWS`` rows or so, for two equal batches."""
    return 2 * max(1, -(-rows // (2 * ROWS)))


def last_changes(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each user and item by ``order``."""
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("n", last).where("n = 1").drop("n")


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest: batch, base, buckets, deltas, order, and the columns' schema."""
    found = read_if_there(spark, f"{path}/manifests", "text")
    if found is None:
        return None
    newest = found.orderBy(F.desc(F.get_json_object("value", "$.batch").cast("long"))).first()
    return json.loads(newest.value) if newest else None


def merged(spark: SparkSession, path: str, held: dict, users: list[int] | None = None) -> DataFrame:
    parts = [spark.read.schema(held["schema"]).parquet(f"{path}/{name}") for name in held["deltas"]]
    if held["base"]:
        base = spark.read.schema(held["schema"] + ", bucket int").parquet(f"{path}/{held['base']}")
        if users is not None:
            asked = spark.createDataFrame([(u,) for u in users], "user_id long").select(bucket_of(held["buckets"]).alias("b"))
            base = base.where(F.col("bucket").isin([r.b for r in asked.distinct().collect()]))
        parts.insert(0, base.drop("bucket"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if users is not None:
        out = out.where(F.col("user_id").isin(users))
    return last_changes(out, held["order"]) if held["deltas"] else out


def latest(spark: SparkSession, path: str, users: list[int] | None = None) -> DataFrame | None:
    """The newest state under ``path``, or None where there is none; for given users only
    their buckets of the base are read."""
    held = manifest(spark, path)
    return None if held is None else merged(spark, path, held, users)


def clear(spark: SparkSession, path: str, held: dict) -> None:
    """Delete what the manifest doesn't name; of manifests all but its own."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in files.listStatus(place):
        if entry.getPath().getName() not in {"manifests", held["base"], *held["deltas"]}:
            files.delete(entry.getPath(), True)
    for entry in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")):
        if entry.getPath().getName() != f"batch={held['batch']}":
            files.delete(entry.getPath(), True)


def apply_batch(batch: DataFrame, number: int, snapshot: str, items: DataFrame, order: list[str]) -> None:
    """Write the batch as a delta, or merge all into a new base, and then its manifest."""
    spark = batch.sparkSession
    held = manifest(spark, snapshot) or {"batch": -1, "base": None, "buckets": 1, "deltas": [], "order": order, "schema": batch.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")}
    if held["batch"] >= number:
        return
    known = batch.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi").select(batch.columns)
    name = f"delta-{number}"
    last_changes(known, order).write.mode("overwrite").parquet(f"{snapshot}/{name}")
    held = held | {"batch": number, "deltas": [*held["deltas"], name]}
    whole = len(held["deltas"]) > DELTAS
    if whole:
        rows = merged(spark, snapshot, held)
        buckets, base = max(1, -(-rows.count() // ROWS)), f"base-{number}"
        rows.withColumn("bucket", bucket_of(buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{snapshot}/{base}")
        held |= {"base": base, "buckets": buckets, "deltas": []}
    spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{snapshot}/manifests/batch={number}")
    if whole:
        clear(spark, snapshot, held)


def upsert_stream(spark: SparkSession, changes: str, snapshot: str, checkpoint: str, items: DataFrame, order: list[str], files: int = 1) -> None:
    """Apply all change files that are there, ``files`` a batch."""
    schema = spark.read.parquet(changes).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(changes)
    run = stream.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, snapshot, items, order))
    run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
