"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, and set a checkpoint folder where
    a local session names none (tests, notebooks). On a cluster there must be one:
    the driver's own disk is not seen by executors."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = context.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="affinity-"))
    return spark


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose results are kept: it
    does so when the driver has collected the frames that named them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was kept under a path of ``scratch`` and isn't read any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def splits(df: DataFrame) -> int:
    """Number of input splits; grows with the data, and sizes key buckets."""
    return max(1, df.rdd.getNumPartitions())


def in_task(sample: DataFrame, work: Callable[[pa.Table], Any]) -> Any:
    """``work`` of a bounded frame, done by one task, so that neither its memory nor a
    retry is the driver's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_pydict({"made": pa.array([pickle.dumps(work(pa.Table.from_batches(held)))], pa.binary())})

    prepare(sample.sparkSession)
    made = sample.coalesce(1).mapInArrow(run, "made binary").collect()  # one row
    return pickle.loads(made[0].made) if made else None


def crc_fold(column: Column | str, modulus: int) -> Column:
    """``crc32`` of the value written as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column) % modulus
