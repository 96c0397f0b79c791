"""Scalers of numeric columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tabwright import config
from tabwright.functions.normal import inverse_normal_cdf
from tabwright.functions.nulls import col, nan_to_null
from tabwright.operators.quantiles import exact_quantiles
from tabwright.operators.stage import StageEstimator, StageModel, param

BOUND = 1e-7  # both ends of the uniform scale, so the normal scale stays within +-5.2


class QuantileNormal(StageEstimator):
    """Maps each column to a standard normal through its own exact quantiles."""

    cols = param("cols", "columns to transform")
    nQuantiles = param("nQuantiles", "number of quantiles")
    DEFAULTS = {"cols": [], "nQuantiles": config.N_QUANTILES}

    def _fit(self, df: DataFrame) -> "QuantileNormalModel":
        cols = self.value("cols")
        if not cols:
            return QuantileNormalModel()
        rows = df.count()
        n = max(2, min(self.value("nQuantiles"), rows))
        probs = {c: [i / (n - 1) for i in range(n)] for c in cols}
        knots = exact_quantiles(df, probs)
        return QuantileNormalModel(cols=cols, knots=[knots[c] for c in cols])


class QuantileNormalModel(StageModel):
    cols = param("cols", "transformed columns")
    knots = param("knots", "quantiles per column")
    DEFAULTS = {"cols": [], "knots": []}

    def _transform(self, df: DataFrame) -> DataFrame:
        knots = {
            c: np.array(k) for c, k in zip(self.value("cols"), self.value("knots")) if c in df.columns and k[0] is not None
        }
        if not knots:
            return df
        names = list(knots)
        schema = T.StructType([T.StructField(f"z{i}", T.DoubleType()) for i in range(len(names))])

        # Only the scaled columns travel to Python, as Arrow batches.
        @F.pandas_udf(schema)
        def scaled(*columns: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({f"z{i}": to_normal(x.to_numpy(dtype=float), knots[c]) for i, (c, x) in enumerate(zip(names, columns))})

        block = df.withColumn("_scaled", scaled(*[col(c).cast("double") for c in names]))
        return block.withColumns({c: nan_to_null(F.col(f"_scaled.z{i}")) for i, c in enumerate(names)}).drop("_scaled")


def to_uniform(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Position of each value among the knots; a run of equal knots takes the
    middle of its positions, values outside take an end."""
    positions = np.linspace(0, 1, len(knots))
    upper = np.interp(x, knots, positions)
    lower = 1 - np.interp(-x, -knots[::-1], positions)
    p = (upper + lower) / 2
    p[x - BOUND < knots[0]] = 0.0
    p[x + BOUND > knots[-1]] = 1.0
    return p


def to_normal(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return inverse_normal_cdf(np.clip(to_uniform(x, knots), BOUND, 1 - BOUND))


class PopulationScaler(StageEstimator):
    """Zero mean, unit population deviation; a constant column is only centred."""

    cols = param("cols", "columns to scale")
    DEFAULTS = {"cols": []}

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        cols = self.value("cols")
        if not cols:
            return PopulationScalerModel()
        row = df.agg(*[F.avg(col(c)) for c in cols], *[F.stddev_pop(col(c)) for c in cols]).first()
        return PopulationScalerModel(
            cols=cols,
            means=[row[i] if row[i] is not None else 0.0 for i in range(len(cols))],
            deviations=[row[len(cols) + i] or 1.0 for i in range(len(cols))],
        )


class PopulationScalerModel(StageModel):
    cols = param("cols", "scaled columns")
    means = param("means", "mean per column")
    deviations = param("deviations", "population deviation per column, 1 for constants")
    DEFAULTS = {"cols": [], "means": [], "deviations": []}

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = {
            c: (col(c) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(self.value("cols"), self.value("means"), self.value("deviations"))
            if c in df.columns
        }
        return df.withColumns(scaled) if scaled else df
