"""Domain features of a property sale, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright import config
from tabwright.functions.nulls import col, fill, is_floating, nan_to_null, sum_with_zero
from tabwright.functions.scalars import (
    clip_upper,
    concat_key,
    cyclic,
    differs,
    first_column_matching,
    is_positive,
    non_negative_diff,
    normalized_name,
)
from tabwright.operators.projection import add_absent, already_transformed, rename_aliases
from tabwright.operators.quantiles import exact_quantiles
from tabwright.operators.stage import StageEstimator, StageModel, param

LOT_QUANTILE = 0.99
CYCLE_MONTHS = 12
MISSING_MONTH = 6


def bath_columns(columns) -> list[tuple[str, float]]:
    """(column, weight) of the bath counts, found by fuzzy name."""
    kinds = [("fullbath", False, 1.0), ("halfbath", False, 0.5), ("bsmtfullbath", True, 1.0), ("bsmthalfbath", True, 0.5)]
    found = []
    for text, basement, weight in kinds:
        name = first_column_matching(
            columns, lambda c: text in normalized_name(c) and ("bsmt" in normalized_name(c)) == basement
        )
        if name:
            found.append((name, weight))
    return found


def second_floor_column(columns) -> str | None:
    return first_column_matching(
        columns, lambda c: ("secondflr" in c.lower() or "2ndflr" in c.lower()) and "sf" in c.lower()
    )


def _numbers(df: DataFrame):
    def number(name: str) -> Column:
        return nan_to_null(col(name)) if is_floating(df, name) else col(name)

    return number


def prepare_names(df: DataFrame, aliases=config.ALIASES) -> DataFrame:
    return add_absent(rename_aliases(df, aliases), config.ABSENT_NUMERIC_DEFAULTS)


def domain_columns(df: DataFrame) -> dict[str, Column]:
    """Derived columns except the quantile clip; ``df`` has prepared names."""
    names = df.columns
    number = _numbers(df)
    floors = next((g for g in config.FLOOR_COLUMNS if all(c in names for c in g)), [])
    baths = bath_columns(names)
    second = second_floor_column(names)
    porches = [c for c in config.PORCH_COLUMNS if c in names]
    zero = F.lit(0.0)

    out = {
        "TotalSF": sum_with_zero([number(c) for c in floors]).cast("double") if floors else zero,
        "TotalBath": sum((fill(number(c), 0) * F.lit(w) for c, w in baths), zero),
        "HouseAge": non_negative_diff(number("YrSold"), number("YearBuilt")).cast("double"),
        "RemodAge": non_negative_diff(number("YrSold"), number("YearRemodAdd")).cast("double"),
        "IsRemodeled": differs(number("YearRemodAdd"), number("YearBuilt")),
        "Has2ndFlr": is_positive(number(second)) if second else F.lit(0),
        "TotalPorchSF": sum_with_zero([number(c) for c in porches]).cast("double") if porches else zero,
        "Quality_Area_Interaction": (number("OverallQual") * number("GrLivArea")).cast("double"),
    }
    if "MoSold" in names:
        month = nan_to_null(F.coalesce(number("MoSold").cast("string"), F.lit(str(MISSING_MONTH))).try_cast("double"))
        out["MoSold_sin"], out["MoSold_cos"] = cyclic(month, CYCLE_MONTHS)
    else:
        out["MoSold_sin"] = out["MoSold_cos"] = zero
    if "Neighborhood" in names and "BldgType" in names:
        out["Loc_Type"] = concat_key(col("Neighborhood"), col("BldgType"))
    else:
        out["Loc_Type"] = F.lit("Unknown_Unknown")
    return out


class DomainFeatures(StageEstimator):
    """Learns the clip of ``LotArea`` once; every other column is row-wise.
    ``scope='frame'`` clips each transformed frame at its own quantile."""

    aliases = param("aliases", "request name to data name")
    scope = param("scope", "'fit' or 'frame'")
    DEFAULTS = {"aliases": config.ALIASES, "scope": "fit"}

    def _fit(self, df: DataFrame) -> "DomainFeaturesModel":
        if already_transformed(df.columns):
            return DomainFeaturesModel(aliases=self.value("aliases"), scope=self.value("scope"), cap=None)
        return DomainFeaturesModel(
            aliases=self.value("aliases"), scope=self.value("scope"), cap=lot_cap(prepare_names(df, self.value("aliases")))
        )


def lot_cap(df: DataFrame) -> float | None:
    values = df.select(_numbers(df)("LotArea").cast("double").alias("LotArea"))
    return exact_quantiles(values, {"LotArea": [LOT_QUANTILE]})["LotArea"][0]


class DomainFeaturesModel(StageModel):
    aliases = param("aliases", "request name to data name")
    scope = param("scope", "'fit' or 'frame'")
    cap = param("cap", "upper bound of LotArea; none when all values are missing")
    DEFAULTS = {"aliases": config.ALIASES, "scope": "fit", "cap": None}

    def _transform(self, df: DataFrame) -> DataFrame:
        if already_transformed(df.columns):
            return df
        named = prepare_names(df, self.value("aliases"))
        cap = lot_cap(named) if self.value("scope") == "frame" else self.value("cap")
        area = _numbers(named)("LotArea").cast("double")
        clipped = fill(area, 0.0) if cap is None else clip_upper(area, cap)
        return named.withColumns({**domain_columns(named), "LotArea_clip": clipped})


def add_domain_features(df: DataFrame) -> DataFrame:
    """Stateless form: the clip is taken from the frame itself."""
    return DomainFeaturesModel(scope="frame").transform(df)
