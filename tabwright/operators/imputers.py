"""Imputers: mode, median and rule tables; infinities and empty columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwright import config
from tabwright.functions.nulls import col, infinity_to_null, is_floating, nan_columns_to_null, nan_to_null
from tabwright.operators.lookup import most_frequent
from tabwright.operators.projection import all_missing_columns
from tabwright.operators.quantiles import exact_quantiles
from tabwright.operators.stage import StageEstimator, StageModel, param


def medians(df: DataFrame, cols) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(nan_columns_to_null(df.select(*[col(c) for c in cols])), {c: [0.5] for c in cols}).items()}


class RuleImputer(StageEstimator):
    """``rules``: column -> (kind, constant), kind one of constant, mode and
    median.  All modes are learned in one job per type, all medians in one."""

    rules = param("rules", "column to (kind, constant)")
    DEFAULTS = {"rules": config.IMPUTE_RULES}

    def _fit(self, df: DataFrame) -> "ImputerModel":
        rules = {c: rule for c, rule in self.value("rules").items() if c in df.columns}
        fills = {c: constant for c, (kind, constant) in rules.items() if kind == "constant"}
        by_mode = [c for c, (kind, _) in rules.items() if kind == "mode"]
        by_median = [c for c, (kind, _) in rules.items() if kind == "median"]
        if by_mode:
            fills.update(most_frequent(nan_columns_to_null(df.select(*[col(c) for c in by_mode])), by_mode))
        if by_median:
            fills.update(medians(df, by_median))
        return ImputerModel(fills={c: fills[c] for c in rules if fills[c] is not None}, numeric=by_median)


class ModeImputer(StageEstimator):
    cols = param("cols", "columns to impute")
    DEFAULTS = {"cols": []}

    def _fit(self, df: DataFrame) -> "ImputerModel":
        return RuleImputer(rules={c: ("mode", None) for c in self.value("cols")}).fit(df)


class MedianImputer(StageEstimator):
    cols = param("cols", "columns to impute")
    DEFAULTS = {"cols": []}

    def _fit(self, df: DataFrame) -> "ImputerModel":
        return RuleImputer(rules={c: ("median", None) for c in self.value("cols")}).fit(df)


class ImputerModel(StageModel):
    fills = param("fills", "column to the value used for missing cells")
    numeric = param("numeric", "columns cast to double, because a median may have a fraction")
    DEFAULTS = {"fills": {}, "numeric": []}

    def _transform(self, df: DataFrame) -> DataFrame:
        filled = {}
        for c, v in self.value("fills").items():
            if c not in df.columns:
                continue
            source = nan_to_null(col(c)) if is_floating(df, c) else col(c)
            if c in self.value("numeric"):
                source = source.cast("double")
            filled[c] = F.coalesce(source, F.lit(v))
        return df.withColumns(filled) if filled else df


class Sanitizer(StageEstimator):
    """Drops columns that are empty in training; infinities become missing."""

    cols = param("cols", "columns to check")
    DEFAULTS = {"cols": None}

    def _fit(self, df: DataFrame) -> "SanitizerModel":
        cols = self.value("cols") if self.value("cols") is not None else df.columns
        return SanitizerModel(dropped=all_missing_columns(df, cols), cols=list(cols))


class SanitizerModel(StageModel):
    dropped = param("dropped", "columns that were empty in training")
    cols = param("cols", "columns to clean")
    DEFAULTS = {"dropped": [], "cols": []}

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in self.value("dropped")]
        return df.select(
            *[
                infinity_to_null(col(c)).alias(c) if c in self.value("cols") and is_floating(df, c) else col(c)
                for c in kept
            ]
        )
