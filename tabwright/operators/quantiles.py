"""Exact quantiles of many columns by narrowing, at any size by the same steps.

One scan counts, for all columns, the values in parts of their range (sixteenths of a power of two, so at most 35 000 a column),
with the least and the greatest value of each part; the counts are combined before the shuffle.  Running sums over the counts tell
which part holds a wanted rank.  The next scan counts in 4096 even parts of what lies between the two ends, for those parts only.  A
part is done when its two ends are equal, and inside a sixteenth of a power of two there are 2^48 numbers, so five scans do at most.
When few values are left in the parts that are not done, they are counted one by one at once.  Counts are shuffled, rows
never are, and the driver gets one row per wanted rank.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.nulls import col

#: Parts of a power of two in the first scan, and of a part in the next ones.
FIRST_PARTS, NEXT_PARTS = 16, 4096
#: Values left up to which each is counted on its own.
FEW_VALUES = 1 << 22


def first_part(value: Column) -> Column:
    """Grows with the value: sixteenths of its logarithm, with its sign; 0 for 0.  The least double gives -17184."""
    place = F.floor(F.least(F.log2(F.abs(value)) * FIRST_PARTS, F.lit(20_000.0))) + 17_200
    return F.when(value == 0, 0).when(value < 0, -place).otherwise(place).cast("double")


def counted(cells: DataFrame) -> DataFrame:
    """Values of each part, and its two ends."""
    return cells.groupBy("column", "group", "part").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def holders(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (column, group, rank, place): the part of ``counts`` that holds the place, and the place within it.

    Parts (at their last place) and wanted places stand in one order; going down, the last part seen holds the place."""
    group = Window.partitionBy("column", "group")
    end = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    held = F.struct("part", "n", "least", "most", "end")
    parts = counts.withColumn("end", end).select("column", "group", (F.col("end") - 1).alias("at"), held.alias("held"), F.lit(None).cast("long").alias("rank"))
    places = wanted.select("column", "group", F.col("place").alias("at"), F.lit(None).cast(parts.schema["held"].dataType).alias("held"), "rank")
    down = group.orderBy(F.desc("at"), F.desc(F.col("held").isNotNull())).rowsBetween(Window.unboundedPreceding, 0)
    found = parts.unionByName(places).withColumn("held", F.last("held", ignorenulls=True).over(down)).filter(F.col("rank").isNotNull())
    place = F.col("at") - F.col("held.end") + F.col("held.n")
    return found.select("column", "group", "rank", place.alias("place"), "held.part", "held.n", "held.least", "held.most")


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles; NULL and NaN are ignored, and a column without values has NULLs."""
    if not probs:
        return {}
    spark, names = df.sparkSession, list(probs)
    cells = df.select(*[col(c).cast("double").alias(c) for c in names]).unpivot([], [f"`{c}`" for c in names], "column", "value")
    cells = cells.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    cells = cells.select("column", "value", F.lit(0).alias("group"), first_part(F.col("value")).alias("part"))
    counts = counted(cells).persist(StorageLevel.MEMORY_AND_DISK)
    totals = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    at = {(c, p): p * (totals[c] - 1) for c in names if c in totals for p in probs[c]}
    ranks = sorted({(c, rank) for (c, _), x in at.items() for rank in (math.floor(x), math.ceil(x))})
    schema = "column string, group int, rank bigint, place bigint"
    wanted = spark.createDataFrame([(c, 0, rank, rank) for c, rank in ranks], schema)
    values = {}
    while ranks:
        found = holders(counts, wanted).collect()
        counts.unpersist()
        values |= {(r["column"], r["rank"]): r["least"] for r in found if r["least"] == r["most"]}
        still = [r for r in found if r["least"] != r["most"]]
        if not still:
            break
        # At most one part per wanted rank.
        parts = {(r["column"], r["group"], r["part"]): (r["least"], r["most"] - r["least"], r["n"]) for r in still}
        numbers = {key: i for i, key in enumerate(parts)}
        held = spark.createDataFrame(
            [(*key, numbers[key], least, width) for key, (least, width, _) in parts.items()],
            "column string, group int, part double, number int, least double, width double",
        )
        inside = cells.join(F.broadcast(held), ["column", "group", "part"])
        few = sum(n for *_, n in parts.values()) <= FEW_VALUES
        part = F.col("value") if few else F.floor((F.col("value") - F.col("least")) / F.col("width") * NEXT_PARTS).cast("double")
        cells = inside.select("column", "value", F.col("number").alias("group"), part.alias("part"))
        counts = counted(cells)
        wanted = spark.createDataFrame([(r["column"], numbers[r["column"], r["group"], r["part"]], r["rank"], r["place"]) for r in still], schema)

    def interpolated(c: str, p: float) -> float | None:
        if c not in totals:
            return None
        x = at[c, p]
        low, high = values[c, math.floor(x)], values[c, math.ceil(x)]
        return low + (high - low) * (x - math.floor(x)) if low != high else low

    return {c: [interpolated(c, p) for p in probs[c]] for c in names}
