"""Connected components of a distributed edge list by alternating large and
small stars (Kiveris et al., "Connected components in MapReduce and beyond").
Each round is two aggregations and two joins on node ids; a node with very many
edges is only ever reduced to its smallest neighbour, and its rows in the joins
may be split by Spark's adaptive skew handling. Rounds are checkpointed; their number
grows with the logarithm of the longest path, squared at worst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another, where root is the
    smallest node of its component; a root itself is not listed.

    ``edges`` has two long columns, in any order and with any repeats; null ends
    and loops are left out. Raises if ``rounds`` don't end it: no half-joined
    components are returned.
    """
    prepare(edges.sparkSession)
    a, b = edges.columns
    star = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
        .checkpoint()
    )
    seen = None
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = (
            large.join(small, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
            .checkpoint()
        )
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components not settled after {rounds} rounds")
