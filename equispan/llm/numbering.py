"""Consecutive numbers for sorted rows, without a task that sees them all."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def numbered(df: DataFrame, *order, name: str = "_at") -> DataFrame:
    """The rows with their place from 0 in ascending `order`; rows equal in all of it get places in any order.

    A range sort deals the rows out, each part counts its own, and the parts' offsets, one row for each part, are added.
    Ties are spread over parts too.  The result is read from a written table, so the places never change.
    """
    keys = [*order, "_tie"]
    parts = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = written(parts.drop("_tie").withColumn("_id", F.monotonically_increasing_id()))
    parts = parts.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_id", "_start")
