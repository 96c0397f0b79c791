"""Profiling: one job per question, whatever the number of columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.nulls import col, is_floating, nan_columns_to_null, numeric_columns
from tabwright.operators.quantiles import exact_quantiles


def is_missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    return (c.isNull() | F.isnan(c)) if is_floating(df, name) else c.isNull()


def missing_counts(df: DataFrame, cols=None) -> tuple[int, dict[str, int]]:
    """(rows, missing cells per column) in one pass."""
    cols = list(cols or df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]
    ).first()
    return row["rows"], {c: row[f"m{i}"] for i, c in enumerate(cols)}


def missing_profile(df: DataFrame, top: int | None = 20) -> DataFrame:
    """Columns with missing cells: count and percent, most affected first."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(is_missing(df, c)).alias(c) for c in cols])
    long = wide.unpivot(["_rows"], [f"`{c}`" for c in cols], "column", "missing").filter("missing > 0")
    out = long.select("column", "missing", (F.col("missing") / F.col("_rows") * 100).alias("missing_pct"))
    out = out.orderBy(F.desc("missing"), "column")
    return out.limit(top) if top else out


def missing_totals(df: DataFrame) -> DataFrame:
    """One row: shape, missing cells, their percent, columns that have any."""
    cols = df.columns
    counts = [F.count_if(is_missing(df, c)) for c in cols]
    total = sum(counts[1:], counts[0])
    affected = sum([(c > 0).cast("bigint") for c in counts[1:]], (counts[0] > 0).cast("bigint"))
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.lit(len(cols)).cast("bigint").alias("columns"),
        total.alias("missing_cells"),
        (F.try_divide(total, rows * len(cols)) * 100).alias("missing_pct"),
        affected.alias("columns_with_missing"),
    )


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: position, type and non-missing count."""
    types = dict(df.dtypes)
    wide = df.agg(*[F.count_if(~is_missing(df, c)).alias(c) for c in df.columns])
    long = wide.unpivot([], [f"`{c}`" for c in df.columns], "column", "non_null")
    position = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    kind = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    return long.select(
        position[F.col("column")].alias("position"), "column", kind[F.col("column")].alias("dtype"), "non_null"
    )


def describe(df: DataFrame, cols=None) -> DataFrame:
    """count, mean, std, min, quartiles and max per column; NaN counts as missing."""
    cols = list(cols or numeric_columns(df))
    df = nan_columns_to_null(df.select(*[col(c) for c in cols]))
    stats = df.agg(
        *[
            F.struct(
                F.count(col(c)).alias("count"),
                F.avg(col(c)).alias("mean"),
                F.stddev_samp(col(c)).alias("std"),
                F.min(col(c)).cast("double").alias("min"),
                F.max(col(c)).cast("double").alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(cols)
        ]
    ).first()
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    rows = [
        (c, s["count"], s["mean"], s["std"], s["min"], *quartiles[c], s["max"])
        for c, s in ((c, stats[f"s{i}"]) for i, c in enumerate(cols))
    ]
    schema = "column string, count bigint, mean double, std double, min double, q25 double, median double, q75 double, max double"
    return df.sparkSession.createDataFrame(rows, schema)


def histogram(df: DataFrame, cols, bins: int = 50) -> DataFrame:
    """(column, bin, low, high, n): equal-width bins; the last one is closed; NaN counts as missing."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    df = nan_columns_to_null(df.select(*[col(c) for c in cols]))
    ends = df.agg(*[F.min(col(c)).cast("double") for c in cols], *[F.max(col(c)).cast("double") for c in cols]).first()
    edges = {}
    for i, c in enumerate(cols):
        low, high = ends[i], ends[len(cols) + i]
        if low is not None:
            edges[c] = (low, high) if low < high else (low - 0.5, high + 0.5)
    if not edges:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, n bigint")
    low_of = F.create_map(*[F.lit(x) for c, e in edges.items() for x in (c, e[0])])[F.col("column")]
    high_of = F.create_map(*[F.lit(x) for c, e in edges.items() for x in (c, e[1])])[F.col("column")]
    long = (
        df.select(*[col(c).cast("double").alias(c) for c in edges])
        .unpivot([], [f"`{c}`" for c in edges], "column", "value")
        .filter(F.col("value").isNotNull())
    )
    step = (high_of - low_of) / bins
    index = F.least(F.floor((F.col("value") - low_of) / step), F.lit(bins - 1)).cast("int")
    counted = long.groupBy("column", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Empty bins are part of a histogram: the frame of columns x bins is tiny.
    spark = df.sparkSession
    frame = spark.createDataFrame([(c,) for c in edges], "column string").select(
        "column", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return frame.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        (low_of + F.col("bin") * step).alias("low"),
        (low_of + (F.col("bin") + 1) * step).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def kernel_density(df: DataFrame, column: str, grid_size: int = 200, cut: float = 0.0) -> DataFrame:
    """Gaussian kernel density on a regular grid, Scott's bandwidth; NaN counts as missing.

    Each task adds its rows to one vector over the grid, so (grid point, sum) pairs leave it and no row is expanded."""
    values = nan_columns_to_null(df.select(col(column).cast("double").alias("value"))).filter("value IS NOT NULL")
    c = F.col("value")
    s = values.agg(F.count(c).alias("n"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high")).first()
    width = (s["std"] or 0.0) * s["n"] ** -0.2 if s["n"] else 0.0
    if not width:
        return df.sparkSession.createDataFrame([], "idx int, x double, density double")
    low, high = s["low"] - cut * width, s["high"] + cut * width
    step = (high - low) / (grid_size - 1)
    grid = low + np.arange(grid_size) * step

    def sums(batches):
        total = np.zeros(grid_size)
        for batch in batches:
            x = batch["value"].to_numpy()
            for start in range(0, len(x), 4096):
                total += np.exp(-0.5 * ((grid[:, None] - x[None, start : start + 4096]) / width) ** 2).sum(axis=1)
        yield pd.DataFrame({"idx": np.arange(grid_size, dtype=np.int32), "part": total})

    parts = values.mapInPandas(sums, "idx int, part double").groupBy("idx").agg(F.sum("part").alias("total"))
    x = F.lit(low) + F.col("idx") * F.lit(step)
    return parts.select("idx", x.alias("x"), (F.col("total") / F.lit(s["n"] * width * (2 * np.pi) ** 0.5)).alias("density"))


def correlation_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Pearson correlation of every ordered pair (a, b), pairwise complete.  NaN counts as missing; a column that is constant
    on the rows of a pair has no correlation there (NULL), nor with itself.

    Each task adds up masked products for all pairs at once, and d * d sums per task are shuffled.  Values are centred first
    for precision."""
    cols = list(cols or numeric_columns(df))
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "a string, b string, corr double")
    clean = nan_columns_to_null(df.select(*[col(c).cast("double").alias(c) for c in cols]))
    means = clean.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centred = clean.select(*[(col(c) - F.lit(means[i] or 0.0)).alias(f"c{i}") for i, c in enumerate(cols)])
    i, j = (x.ravel() for x in np.indices((len(cols), len(cols))))

    def sums(batches):
        acc = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float, na_value=np.nan)
            mask = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            part = [mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x]
            acc = part if acc is None else [p + q for p, q in zip(acc, part)]
        if acc is not None:
            n, sx, sxx, sxy = acc
            yield pd.DataFrame(dict(i=i, j=j, n=n[i, j], sx=sx[i, j], sy=sx[j, i], sxx=sxx[i, j], syy=sxx[j, i], sxy=sxy[i, j]))

    moments = ("n", "sx", "sy", "sxx", "syy", "sxy")
    schema = "i int, j int, " + ", ".join(f"{k} double" for k in moments)
    parts = centred.mapInPandas(sums, schema).groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in moments])
    of = {k: F.col(k) for k in moments}
    n = F.when(of["n"] > 0, of["n"])
    x_var, y_var = of["sxx"] - of["sx"] * of["sx"] / n, of["syy"] - of["sy"] * of["sy"] / n
    # What rounding leaves of a constant column is no variance.
    varies = (x_var > 1e-12 * of["sxx"]) & (y_var > 1e-12 * of["syy"])
    names = F.array(*[F.lit(c) for c in cols])
    pair = (of["sxy"] - of["sx"] * of["sy"] / n) / F.sqrt(F.when(varies, x_var * y_var))
    return parts.select(
        F.get(names, F.col("i")).alias("a"),
        F.get(names, F.col("j")).alias("b"),
        F.when(F.col("i") == F.col("j"), F.when(varies, F.lit(1.0))).otherwise(pair).alias("corr"),
    )


def top_correlated(df: DataFrame, target: str, k: int = 10, cols=None) -> DataFrame:
    """Columns by |correlation| with the target, the target itself first; columns without one last."""
    cols = [target] + [c for c in (cols or numeric_columns(df)) if c != target]
    with_target = correlation_matrix(df, cols).filter(F.col("b") == target).select(F.col("a").alias("column"), "corr")
    return with_target.orderBy(F.desc(F.col("column") == target), F.desc_nulls_last(F.abs("corr")), "column").limit(k)


def target_summary(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"), F.stddev_samp(label).alias("std")
    )


def group_count_mean(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(label).alias("count"), F.avg(label).alias("mean"))


def distinct_levels(df: DataFrame, cols) -> DataFrame:
    from tabwright.operators.lookup import long_levels

    return long_levels(df, cols).distinct()
