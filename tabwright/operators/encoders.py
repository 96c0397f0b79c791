"""Encoders of categorical columns: ordinal ranks, missing flags, rare levels,
smoothed target means and one-hot vectors."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, functions as F

from tabwright import config
from tabwright.functions.nulls import col, missing_flag, nan_to_null, numeric_columns, text_or_nan, is_floating
from tabwright.operators.lookup import LITERAL_LEVELS, LevelTable, level_counts, map_levels
from tabwright.operators.profile import missing_counts
from tabwright.operators.ranks import row_index
from tabwright.operators.stage import StageEstimator, StageModel, StageTransformer, TableModel, param


class OrdinalMapper(StageTransformer):
    """Level -> rank by configured order; unknown and missing levels -> NULL."""

    mapping = param("mapping", "column to ordered levels")
    DEFAULTS = {"mapping": config.ORDINAL_LEVELS}

    def _transform(self, df: DataFrame) -> DataFrame:
        ranks = {
            c: map_levels(col(c), {level: float(i) for i, level in enumerate(order)})
            for c, order in self.value("mapping").items()
            if c in df.columns
        }
        return df.withColumns(ranks) if ranks else df


class MissingFlags(StageEstimator):
    """Learns which columns have gaps; adds ``<c>_was_missing`` for them."""

    cols = param("cols", "columns to flag; None finds numeric columns with gaps")
    exclude = param("exclude", "columns never flagged when cols is None")
    autoNumeric = param("autoNumeric", "whether to look for columns when cols is None")
    DEFAULTS = {"cols": None, "exclude": [], "autoNumeric": True}

    def _fit(self, df: DataFrame) -> "MissingFlagsModel":
        if self.value("cols") is not None:
            return MissingFlagsModel(cols=[c for c in self.value("cols") if c in df.columns])
        names = numeric_columns(df, self.value("exclude")) if self.value("autoNumeric") else []
        gaps = missing_counts(df, names)[1] if names else {}
        return MissingFlagsModel(cols=[c for c in names if gaps[c]])


class MissingFlagsModel(StageModel):
    cols = param("cols", "flagged columns")
    DEFAULTS = {"cols": []}

    def output_columns(self) -> list[str]:
        return [f"{c}_was_missing" for c in self.value("cols")]

    def _transform(self, df: DataFrame) -> DataFrame:
        flags = {
            f"{c}_was_missing": missing_flag(nan_to_null(col(c)) if is_floating(df, c) else col(c))
            for c in self.value("cols")
            if c in df.columns
        }
        return df.withColumns(flags) if flags else df


class RarePooler(StageEstimator):
    """Keeps levels with count >= max(minCount, minShare * rows)."""

    cols = param("cols", "columns to pool")
    minCount = param("minCount", "absolute threshold")
    minShare = param("minShare", "threshold as a share of the rows")
    other = param("other", "name of the pooled level")
    DEFAULTS = {"cols": [], "minCount": None, "minShare": None, "other": "Other"}

    def _fit(self, df: DataFrame) -> "RarePoolerModel":
        cols = [c for c in self.value("cols") if c in df.columns]
        threshold = self.value("minCount") or 0
        if self.value("minShare") is not None:
            threshold = max(threshold, self.value("minShare") * df.count())
        model = RarePoolerModel(cols=cols, other=self.value("other"))
        kept = level_counts(df, cols) if cols else df.sparkSession.createDataFrame([], "column string, level string, n bigint")
        kept = kept.filter(F.col("n") >= threshold).withColumn("value", F.lit(1.0))
        model.levels = LevelTable(kept, cols)
        return model


class RarePoolerModel(TableModel):
    cols = param("cols", "pooled columns")
    other = param("other", "name of the pooled level")
    DEFAULTS = {"cols": [], "other": "Other"}
    levels: LevelTable | None = None

    def save_state(self, path: str) -> None:
        self.levels.save(path)

    def load_state(self, spark, path: str) -> None:
        self.levels = LevelTable.load(spark, path, self.value("cols"))

    def _transform(self, df: DataFrame) -> DataFrame:
        other = F.lit(self.value("other"))
        pooled = {}
        for c in self.value("cols"):
            if c not in df.columns:
                continue
            text = text_or_nan(col(c))
            if c in self.levels.literals:
                kept = text.isin(list(self.levels.literals[c]))
            else:
                df = self.levels.join_value(df, c, f"_kept_{c}")
                kept = col(f"_kept_{c}").isNotNull()
            pooled[c] = F.when(kept, text).otherwise(other)
        out = df.withColumns(pooled) if pooled else df
        return out.drop(*[f"_kept_{c}" for c in pooled])


class TargetEncoder(StageEstimator):
    """TE = (n * mean + alpha * g) / (n + alpha), g = mean of the label."""

    cols = param("cols", "columns to encode")
    labelCol = param("labelCol", "label column")
    alpha = param("alpha", "smoothing")
    prefix = param("prefix", "prefix of the added columns")
    DEFAULTS = {"cols": [], "labelCol": "label", "alpha": 10.0, "prefix": "TE_"}

    def _fit(self, df: DataFrame) -> "TargetEncoderModel":
        cols = [c for c in self.value("cols") if c in df.columns]
        label, alpha = self.value("labelCol"), float(self.value("alpha"))
        g = df.agg(F.avg(col(label))).first()[0]
        model = TargetEncoderModel(cols=cols, prefix=self.value("prefix"), globalMean=g)
        if not cols:
            model.levels = LevelTable(df.sparkSession.createDataFrame([], LevelTable.SCHEMA), cols)
            return model
        y = F.col("_label")
        long = _labelled_levels(df, cols, label)
        stats = long.filter(F.col("level").isNotNull()).groupBy("column", "level").agg(
            F.count(y).alias("n"), F.avg(y).alias("mean")
        )
        smooth = (F.col("n") * F.col("mean") + F.lit(alpha * g)) / (F.col("n") + F.lit(alpha))
        model.levels = LevelTable(stats.select("column", "level", "n", smooth.alias("value")), cols)
        return model


def _labelled_levels(df: DataFrame, cols, label: str) -> DataFrame:
    wide = df.select(col(label).cast("double").alias("_label"), *[col(c).cast("string").alias(c) for c in cols])
    return wide.unpivot(["_label"], [f"`{c}`" for c in cols], "column", "level")


class TargetEncoderModel(TableModel):
    cols = param("cols", "encoded columns")
    prefix = param("prefix", "prefix of the added columns")
    globalMean = param("globalMean", "value of unseen and missing levels")
    DEFAULTS = {"cols": [], "prefix": "TE_", "globalMean": None}
    levels: LevelTable | None = None

    def output_columns(self) -> list[str]:
        return [self.value("prefix") + c for c in self.value("cols")]

    def save_state(self, path: str) -> None:
        self.levels.save(path)

    def load_state(self, spark, path: str) -> None:
        self.levels = LevelTable.load(spark, path, self.value("cols"))

    def _transform(self, df: DataFrame) -> DataFrame:
        g = F.lit(self.value("globalMean"))
        encoded = {}
        for c in self.value("cols"):
            out = self.value("prefix") + c
            if c not in df.columns:
                continue
            if c in self.levels.literals:
                encoded[out] = F.coalesce(self.levels.literal_value(c, col(c).cast("string")), g)
            else:
                df = self.levels.join_value(df, c, out)
                encoded[out] = F.coalesce(F.when(col(c).isNotNull(), col(out)), g)
        return df.withColumns(encoded) if encoded else df


def one_hot_slots(counts: DataFrame) -> DataFrame:
    """(column, level, n, value): the place of each level among the sorted levels of its column.  Levels are dealt out by ranges, and the
    sizes of the ranges before give the places, so no level goes to the driver and no column to one task."""
    placed = row_index(counts, ["column", "level"], "place")
    firsts = placed.groupBy("column").agg(F.min("place").alias("first"))
    slots = placed.join(F.broadcast(firsts), "column")  # one row a column
    return slots.select("column", "level", "n", (F.col("place") - F.col("first")).cast("double").alias("value"))


class OneHotLevels(StageEstimator):
    """One slot per level in sorted order, as many as the data has; unknown and missing -> all zeros."""

    cols = param("cols", "columns to encode")
    suffix = param("suffix", "suffix of the vector columns")
    DEFAULTS = {"cols": [], "suffix": "_ohe"}

    def _fit(self, df: DataFrame) -> "OneHotLevelsModel":
        cols, suffix = self.value("cols"), self.value("suffix")
        if not cols:
            return OneHotLevelsModel(suffix=suffix)
        counts = level_counts(df, cols, keep_null=True).filter(F.col("level").isNotNull())
        bound = LITERAL_LEVELS * len(cols)
        few = counts.limit(bound + 1).collect()
        if len(few) <= bound and all(sum(r["column"] == c for r in few) <= LITERAL_LEVELS for c in cols):
            found = {c: {r["level"]: r["n"] for r in few if r["column"] == c} for c in cols}
            return OneHotLevelsModel.of_counts([found[c] for c in cols], cols=cols, suffix=suffix)
        table = LevelTable(one_hot_slots(counts), cols)
        model = OneHotLevelsModel.of_counts([table.counts.get(c) for c in cols], cols=cols, suffix=suffix)
        model.levels = table
        return model._set(sizes=[table.sizes[c] for c in cols])


class OneHotLevelsModel(TableModel):
    """Few levels are literals.  The slots of a column with many are a table, joined by level."""

    cols = param("cols", "encoded columns")
    labels = param("labels", "sorted levels per column; null where they are a table")
    frequent = param("frequent", "the same levels, most frequent first")
    sizes = param("sizes", "number of levels per column")
    suffix = param("suffix", "suffix of the vector columns")
    DEFAULTS = {"cols": [], "labels": [], "frequent": [], "sizes": [], "suffix": "_ohe"}
    levels: LevelTable | None = None

    @classmethod
    def of_counts(cls, counts: list[dict[str, int] | None], **values) -> "OneHotLevelsModel":
        frequent = [None if found is None else [level for level, _ in sorted(found.items(), key=lambda e: (-e[1], e[0]))] for found in counts]
        labels = [None if f is None else sorted(f) for f in frequent]
        return cls(labels=labels, frequent=frequent, sizes=[len(f or []) for f in frequent], **values)

    def wide_columns(self) -> list[str]:
        return [c for c, labels in zip(self.value("cols"), self.value("labels")) if labels is None]

    def output_columns(self) -> list[str]:
        return [c + self.value("suffix") for c in self.value("cols")]

    def save_state(self, path: str) -> None:
        if self.wide_columns():
            self.levels.save(path)

    def load_state(self, spark, path: str) -> None:
        if self.wide_columns():
            self.levels = LevelTable.load(spark, path, self.value("cols"))

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.value("cols")
        if not cols:
            return df
        index, indexed = {}, df
        for c, labels, frequent, size in zip(cols, self.value("labels"), self.value("frequent"), self.value("sizes")):
            name, size = f"_idx_{c}", max(size, 1)
            if labels is None:
                indexed = self.levels.join_value(indexed, c, name)
                slot = F.coalesce(F.when(col(c).isNotNull(), col(name)), F.lit(float(size)))
            else:
                # Few levels: one literal search, frequent levels first.
                slot_of = {level: i for i, level in enumerate(labels)}
                slots = F.lit([float(slot_of[level]) for level in frequent] or [0.0])
                found = F.array_position(F.lit(frequent or ["<none>"]), col(c)).cast("int")
                slot = F.coalesce(F.get(slots, found - 1), F.lit(float(size)))
            # The declared size lets the encoder skip its pass over the data;
            # the index after the last level is invalid and becomes all zeros.
            index[name] = slot.alias(name, metadata={"ml_attr": {"type": "nominal", "num_vals": size}})
        indexed = indexed.select(*[col(c) for c in indexed.columns if c not in index], *index.values())
        encoder = OneHotEncoder(
            inputCols=list(index), outputCols=self.output_columns(), dropLast=True, handleInvalid="keep"
        )
        return encoder.fit(indexed).transform(indexed).drop(*index)
