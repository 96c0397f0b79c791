"""Row functions: arithmetic, text and response shaping."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, functions as F

from tabwright import config
from tabwright.functions.nulls import text_or_nan


def clip_lower(c: Column, low) -> Column:
    # greatest() skips NULL, so a missing value would turn into the bound.
    return F.when(c < F.lit(low), F.lit(low)).otherwise(c)


def clip_upper(c: Column, high) -> Column:
    return F.when(c > F.lit(high), F.lit(high)).otherwise(c)


def concat_key(*columns: Column, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[text_or_nan(c) for c in columns])


def non_negative_diff(later: Column, earlier: Column) -> Column:
    return clip_lower(later - earlier, 0)


def differs(a: Column, b: Column) -> Column:
    """1 where the values differ; a missing value differs from everything."""
    return F.when(a.isNull() | b.isNull() | (a != b), 1).otherwise(0)


def is_positive(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False)).cast("int")


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * (c / F.lit(float(period)))
    return F.sin(angle), F.cos(angle)


def log_target(c: Column) -> Column:
    return F.log1p(c)


def unlog_target(c: Column) -> Column:
    return F.expm1(c)


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def percent_error(actual: Column, predicted: Column) -> Column:
    return F.abs(F.try_divide(actual - predicted, actual) * 100)


def currency_text(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def percent_text(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 1), F.lit("%"))


def confidence_color(c: Column) -> Column:
    return F.when(c >= 0.8, "green").when(c >= 0.6, "orange").otherwise("red")


def confidence_level(c: Column) -> Column:
    """Second scale: the same three colours with tighter limits."""
    return F.when(c >= 0.9, "green").when(c >= 0.7, "yellow").otherwise("red")


def contribution_type(shap: Column) -> Column:
    return F.when(shap > 0, "positive").otherwise("negative")


def contribution_sentence(shap: Column, feature: Column, value: Column) -> Column:
    word = F.when(shap > 0, "raises").otherwise("lowers")
    return F.concat(
        word, F.lit(" the price by "), currency_text(F.abs(shap)), F.lit(" through "),
        feature, F.lit("="), F.coalesce(value.cast("string"), F.lit("None")),
    )


def clean_feature_name(c: Column, prefixes=config.FEATURE_PREFIXES) -> Column:
    pattern = "^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"
    return F.regexp_replace(c, pattern, "")


def normalized_name(name: str) -> str:
    """Column name without case, blanks and underscores, for fuzzy matching."""
    return name.lower().replace(" ", "").replace("_", "")


def first_column_matching(columns, test) -> str | None:
    return next((c for c in columns if test(c)), None)
