"""Places of rows in a total order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.session import materialise


def number_in_order(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 on.

    Rows are dealt out by ranges and numbered in each; what stands before a range comes from
    the ranges' counts, one row for each.  Ties are numbered in some order.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    dealt = materialise(dealt.withColumn("_n", number), "ordered")
    part = F.shiftright("_n", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_count"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    return (
        dealt.withColumn("_part", part).join(F.broadcast(bases), "_part")  # a row per task of one stage
        .withColumn(name, F.col("_base") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_n", "_part", "_base")
    )
