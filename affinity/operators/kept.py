"""Frames kept as Parquet in the folder that driver and executors share, and what needs them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def workers_find_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the session was started."""
    known = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH", "")]))


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, or else in the one given to
    ``setCheckpointDir``. Where there is neither, a local session gets a temporary folder;
    on a cluster that would be the driver's own disk."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        base = getattr(spark.sparkContext, "getCheckpointDir", lambda: None)()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="affinity-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_if_there(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """What is kept under ``path``, or None where there is nothing."""
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame, written once; for what several joins read."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame of ``keep`` that isn't read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """With each row's place in the whole order, from 1: sorted by ranges, numbered inside
    them, and shifted by the sizes of the ranges before. ``order`` must leave no ties."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = keep(ranges.select("*", F.spark_partition_id().alias("_range"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")), name)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return ranges.join(F.broadcast(shift), "_range").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))
