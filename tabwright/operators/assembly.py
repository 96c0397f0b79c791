"""The feature vector and the table of its slot names."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.nulls import col
from tabwright.operators.lookup import LevelTable
from tabwright.operators.stage import StageTransformer, param


class FeatureRouter(StageTransformer):
    """Assembles, in order: one-hot blocks, ordinals, complete numerics,
    numerics with gaps, then the passed-through columns."""

    oneHot = param("oneHot", "[source column, vector column, levels or null, number of levels]")
    scalars = param("scalars", "[column, source column, kind]")
    outputCol = param("outputCol", "vector column")
    DEFAULTS = {"oneHot": [], "scalars": [], "outputCol": "features"}

    def blocks(self) -> list[tuple[int, str, list[str] | None, int]]:
        """First slot, source column, levels (None where they are a table) and size of each one-hot block, and where the next begins."""
        out, at = [], 0
        for c, _, levels, size in self.value("oneHot"):
            out.append((at, c, levels, max(size, 1)))
            at += max(size, 1)
        return [*out, (at, None, None, 0)]

    def names(self) -> list[tuple[int, str, str, str]]:
        """(index, feature name, source column, kind) of every slot whose level is known here."""
        *blocks, (end, *_) = self.blocks()
        slots = [(at + i, f"{c}_{level}", c, "one_hot") for at, c, levels, _ in blocks if levels is not None for i, level in enumerate(levels or ["<none>"])]
        return slots + [(end + i, *s) for i, s in enumerate(self.value("scalars"))]

    def _transform(self, df: DataFrame) -> DataFrame:
        inputs = [vector for _, vector, *_ in self.value("oneHot")] + [c for c, _, _ in self.value("scalars")]
        numbers = {c: col(c).cast("double") for c, _, _ in self.value("scalars")}
        cast = df.withColumns(numbers) if numbers else df
        out = VectorAssembler(inputCols=inputs, outputCol=self.value("outputCol"), handleInvalid="keep").transform(cast)
        return out.drop(*[vector for _, vector, *_ in self.value("oneHot")])


def feature_name_table(spark, router: FeatureRouter, levels: LevelTable | None = None) -> DataFrame:
    """One row per slot.  The names of wide one-hot blocks come from their level table."""
    names = spark.createDataFrame(router.names(), "idx int, name string, source_column string, kind string")
    for at, c, known, _ in router.blocks()[:-1]:
        if known is None:
            slots = levels.levels_of(c).select(
                (F.col("value") + at).cast("int").alias("idx"),
                F.concat(F.lit(f"{c}_"), "level").alias("name"),
                F.lit(c).alias("source_column"),
                F.lit("one_hot").alias("kind"),
            )
            names = names.unionByName(slots)
    return names
