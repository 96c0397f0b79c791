"""Column and row preparation: names, defaults, validation, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwright import config
from tabwright.functions.nulls import col, is_floating, nan_to_null, numeric_columns, text_to_double
from tabwright.operators.profile import missing_counts


def drop_identifier(df: DataFrame, row_id: str = "Id") -> DataFrame:
    return df.drop(row_id)


def feature_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def separate_target(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return df.withColumn(label, col(target).cast("double")).drop(*([target] if target != label else []))


def rename_aliases(df: DataFrame, aliases=config.ALIASES) -> DataFrame:
    """Request name -> data name, where the data name is not there already."""
    present = set(df.columns)
    return df.withColumnsRenamed({a: d for a, d in aliases.items() if a in present and d not in present})


def add_absent(df: DataFrame, defaults: dict) -> DataFrame:
    """Add columns the table lacks; NULLs of existing columns stay."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def merge_defaults(
    df: DataFrame, defaults=config.RECORD_DEFAULTS, aliases=config.ALIASES, fill_nulls: bool = False
) -> DataFrame:
    """Start from the defaults, override with the record.  A supplied missing
    value overrides too, unless ``fill_nulls`` asks for a per-cell default."""
    spelled = {aliases[c] if aliases.get(c) in df.columns else c: v for c, v in defaults.items()}
    out = add_absent(df, spelled)
    if fill_nulls:
        filled = {c: F.coalesce(col(c), F.lit(v)) for c, v in spelled.items() if c in df.columns}
        out = out.withColumns(filled) if filled else out
    return out


def align_columns(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Add every expected column the input lacks: 0, as text for text columns."""
    return add_absent(
        df.select("*"), {c: "0" if kind == "string" else 0 for c, kind in expected.items()}
    )


def unique_columns(df: DataFrame, names) -> DataFrame:
    """Keep the first of columns that share a name (``names`` by position)."""
    seen, keep = set(), []
    positional = df.toDF(*[f"_{i}" for i in range(len(names))])
    for i, name in enumerate(names):
        if name not in seen:
            seen.add(name)
            keep.append(F.col(f"_{i}").alias(name))
    return positional.select(*keep)


def already_transformed(columns) -> bool:
    return len(columns) > 100 and any(c.startswith("f") and c[1:].isdigit() for c in columns)


def normalize_records(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Map file columns to feature names and turn NaN into NULL."""
    mapping = mapping or {c: c for c in df.columns}
    return df.select(
        *[
            (nan_to_null(col(c)) if is_floating(df, c) else col(c)).alias(name)
            for c, name in mapping.items()
            if c in df.columns
        ]
    )


def validation_error(columns, required=(), non_negative=config.NON_NEGATIVE_FIELDS) -> Column:
    """Message of the first failing rule, NULL for a valid row."""
    rules = []
    for c in required:
        failed = col(c).isNull() if c in columns else F.lit(True)
        rules.append(F.when(failed, F.lit(f"field '{c}' is required")))
    for c in non_negative:
        if c in columns:
            rules.append(F.when(col(c) < 0, F.lit(f"{c} must not be negative")))
    return F.coalesce(*rules) if rules else F.lit(None).cast("string")


def validate_batch(df: DataFrame, max_rows: int | None = None, recommended=config.RECOMMENDED_FIELDS) -> dict:
    """Check an upload before scoring.  No cap by default; with one, no more
    than ``max_rows + 1`` rows are looked at."""
    advice = [c for c in recommended if c not in df.columns]
    seen = df.limit((max_rows or 0) + 1).count()
    if seen == 0:
        return {"valid": False, "error": "the batch is empty", "absent_recommended": advice}
    if max_rows is not None and seen > max_rows:
        return {"valid": False, "error": f"more than {max_rows} rows", "absent_recommended": advice}
    return {"valid": True, "error": None, "absent_recommended": advice}


def enforce_schema(df: DataFrame, fields: dict[str, str], error: str = "error") -> DataFrame:
    """Cast each known field; a value that does not fit is set to NULL and named
    in ``error`` instead of failing the job.  Unknown columns pass through."""
    # A number with a fraction is no integer: the cast back must agree.
    casts, rules = {}, []
    for c, kind in fields.items():
        if c not in df.columns:
            continue
        source = df.schema[c].dataType
        if kind == "string":
            if not isinstance(source, T.StringType):
                casts[c] = col(c).cast("string")
            continue
        number = nan_to_null(text_to_double(col(c)) if isinstance(source, T.StringType) else col(c).try_cast("double"))
        fits = number.isNotNull()
        if kind == "int":
            fits = fits & (number == F.floor(number)) & number.between(-2147483648, 2147483647)
        casts[c] = F.when(fits, number.try_cast(kind))
        present = ~F.isnan(col(c)) if is_floating(df, c) else F.lit(True)
        rules.append(F.when(col(c).isNotNull() & present & ~F.coalesce(fits, F.lit(False)), F.lit(f"{c} is not {kind}")))
    problem = F.coalesce(*rules) if rules else F.lit(None).cast("string")
    previous = [col(error)] if error in df.columns else []
    return df.withColumns({**casts, error: F.coalesce(*previous, problem)})


def keep_successful(df: DataFrame, error: str = "error") -> DataFrame:
    return df.filter(col(error).isNull())


def all_missing_columns(df: DataFrame, cols) -> list[str]:
    rows, missing = missing_counts(df, cols)
    return [c for c in cols if missing[c] == rows]


def route_features(train: DataFrame, cols, ordinals, test: DataFrame | None = None) -> dict[str, list[str]]:
    """Split columns into categorical, ordinal, numeric_complete and
    numeric_missing.  A numeric column counts as missing if train or test has a
    gap; both are profiled in one job each."""
    ordinal = [c for c in ordinals if c in cols]
    categorical = [f.name for f in train.schema if f.name in cols and isinstance(f.dataType, T.StringType) and f.name not in ordinal]
    numeric = [c for c in numeric_columns(train) if c in cols and c not in ordinal]
    gaps = dict.fromkeys(numeric, 0)
    for frame in (train, test):
        if frame is not None and numeric:
            for c, n in missing_counts(frame, numeric)[1].items():
                gaps[c] += n
    return {
        "categorical": categorical,
        "ordinal": ordinal,
        "numeric_complete": [c for c in numeric if not gaps[c]],
        "numeric_missing": [c for c in numeric if gaps[c]],
    }


def preview(df: DataFrame, row_id: str, n: int = 10) -> DataFrame:
    return df.orderBy(row_id).limit(n)
