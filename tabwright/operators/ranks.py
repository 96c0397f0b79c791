"""Dense numbers for the rows of a table in a given order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import materialize

#: Spark's increasing row numbers hold the partition above this bit and the row within it below.
PARTITION_BIT = 33


def row_index(df: DataFrame, order: list[str | Column], name: str = "index") -> DataFrame:
    """``df`` with ``name``: 0 for the first row in ``order``, 1 for the next, and so on.

    The rows are dealt out by ranges of ``order``, sorted within each and written; the sizes of the ranges before give each range
    its offset.  Only those sizes, one number a range, meet in one task.  Rows that are equal in ``order`` get different numbers."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = materialize(ranged.withColumn(name, F.monotonically_increasing_id()), "ranks")
    part = F.shiftright(F.col(f"`{name}`"), PARTITION_BIT)
    sizes = table.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.col(f"`{name}`").bitwiseAND(F.lit((1 << PARTITION_BIT) - 1))
    placed = table.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, within + F.col("__before")).drop("__part", "__before")
