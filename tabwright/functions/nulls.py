"""Missing-value rules.  Spark has NULL and NaN; data frames have one marker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """A top-level column whose name may hold dots or start with a digit."""
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def infinity_to_null(c: Column) -> Column:
    # NaN compares greater than infinity, so it becomes NULL as well.
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def nan_columns_to_null(df: DataFrame) -> DataFrame:
    """Apply ``nan_to_null`` to every floating column in one projection."""
    return df.select(
        *[nan_to_null(col(f.name)).alias(f.name) if is_floating(df, f.name) else col(f.name) for f in df.schema]
    )


def tokens_to_null(c: Column, tokens) -> Column:
    return F.when(~c.isin(list(tokens)), c)


def text_or_nan(c: Column) -> Column:
    """Cast to text; a missing value becomes the text ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def safe_double(c: Column) -> Column:
    return nan_to_null(c.try_cast("double"))


# Text that is a number; a cast alone also takes "1F" and "2D".
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def text_to_double(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def fill(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def sum_with_zero(columns) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])
