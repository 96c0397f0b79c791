"""The turns of conversations in order, in ranges that no conversation can make large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.ranks import PARTITION_BIT
from tabwright.session import materialize


def content_digest(*values: str | Column) -> Column:
    """16 bytes for texts without nulls, each told apart by its length."""
    parts = [p for v in values for p in (F.char_length(v).cast("string"), F.lit(":"), F.col(v) if isinstance(v, str) else v)]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def range_of(pos: str | Column) -> Column:
    return F.shiftright(pos, PARTITION_BIT)


def in_order(turns: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """conv_id, turn, ``digest`` of role and text (which have no nulls) and ``columns``, written in order of conversation, turn (null first)
    and digest, with ``pos``, a number that grows in this order.

    Rows are dealt out by ranges of that order.  A number of the row at the end of the key parts even rows that are equal in all of
    it, so a conversation with a third of all rows goes to many ranges, whatever its turns are."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), content_digest("role", "text").alias("digest"), *columns
    )
    order = ["conv_id", "turn", "digest"]
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *order, "number").drop("number").sortWithinPartitions(*order)
    return materialize(rows.withColumn("pos", F.monotonically_increasing_id()), name)


def placed(rows: DataFrame, *columns: str) -> DataFrame:
    """conv_id, ``place`` (1 for the first row of a conversation) and ``columns`` of an ordered table.

    A conversation's rows are numbered within each range; a range that a conversation does not begin in adds the sizes of those before.
    At most two conversations of a range go on beyond it, so the table of those sizes is as small as the number of ranges."""
    found = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    local = rows.groupBy("conv_id", range_of("pos").alias("part")).agg(found.alias("rows")).select("conv_id", "part", F.posexplode("rows").alias("place", "row"))
    sizes = rows.groupBy("conv_id", range_of("pos").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).filter(F.size("parts") > 1)
    each = parts.select("conv_id", "parts", F.posexplode("parts").alias("k", "at"))
    before = F.aggregate(F.expr("slice(parts, 1, k)"), F.lit(0).cast("long"), lambda sum_, p: sum_ + p.n)
    parted = each.select(F.col("conv_id").alias("its_id"), F.col("at.part").alias("its_part"), before.alias("before"))
    held = local.join(F.broadcast(parted), F.col("conv_id").eqNullSafe(F.col("its_id")) & (F.col("part") == F.col("its_part")), "left")
    return held.select("conv_id", (F.col("place") + 1 + F.coalesce("before", F.lit(0))).alias("place"), *(f"row.{c}" for c in columns))
