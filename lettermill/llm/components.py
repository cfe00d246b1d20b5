"""Connected components of a graph in tables, by alternating stars.

Each round hangs every node on the smallest node that it or its neighbours know, which
halves long paths and never makes more links than there were.  A link table is written to
the shared folder after each round, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.session import materialise


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (smallest node that can be reached) of all nodes in ``links``.

    ``links`` has columns ``a`` and ``b``.  Loops, repeated links and nulls add nothing.
    """
    now = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    now = materialise(now, "links")
    seen = _digest(now)
    for _ in range(max_rounds):
        now = materialise(_small_star(_large_star(now)), "links")
        digest = _digest(now)
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    roots = now.select(F.col("low").alias("node")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        roots.withColumn("root", F.col("node")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest neighbour of that node."""
    smallest = links.groupBy("high").agg(F.min("low").alias("best")).withColumnRenamed("high", "low")
    return links.join(smallest, "low", "left").select("high", F.coalesce("best", "low").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of these."""
    smallest = links.groupBy("high").agg(F.min("low").alias("best"))
    moved = links.join(smallest, "high").where(F.col("low") != F.col("best")).select(
        F.col("low").alias("high"), F.col("best").alias("low"))
    return moved.unionByName(smallest.withColumnRenamed("best", "low")).distinct()


def _digest(links: DataFrame) -> tuple:
    """Tells whether two link tables are equal; ``decimal`` sums do not overflow."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    return tuple(row)
