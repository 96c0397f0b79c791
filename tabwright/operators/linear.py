"""One- and two-feature least squares as plain aggregates, per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabwright.functions.nulls import col


def ols_by_group(df: DataFrame, by, feature: str, label: str) -> DataFrame:
    """slope, intercept and r2 of label ~ feature in every group: one pass,
    partial sums before the shuffle."""
    y, x = col(label).cast("double"), col(feature).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def ridge_two_features(df: DataFrame, a: str, b: str, label: str, alpha: float) -> DataFrame:
    """Closed form of ridge with an unpenalised intercept, from centred sums."""
    x1, x2, y = (col(c).cast("double") for c in (a, b, label))
    n = F.count(F.lit(1))
    s = df.agg(
        *[c.alias(k) for k, c in {
            "m1": F.avg(x1), "m2": F.avg(x2), "my": F.avg(y),
            "s11": F.var_pop(x1) * n + alpha, "s22": F.var_pop(x2) * n + alpha, "s12": F.covar_pop(x1, x2) * n,
            "s1y": F.covar_pop(x1, y) * n, "s2y": F.covar_pop(x2, y) * n,
        }.items()]
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    w1 = (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / det
    w2 = (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / det
    return s.select(
        w1.alias("w1"), w2.alias("w2"), (F.col("my") - w1 * F.col("m1") - w2 * F.col("m2")).alias("intercept")
    )


def one_feature_cv(df: DataFrame, features, label: str, fold: str = "fold") -> DataFrame:
    """CV scores of one least-squares line per feature, all features and folds
    together: (model, fold, rmse, r2).

    Rows go to long form (feature, fold, x, y); the sums of a fold, taken from
    the sums of all rows, give the line fitted without that fold."""
    y = F.col("_y")
    wide = df.select(col(fold).alias("fold"), col(label).cast("double").alias("_y"), *[col(c).cast("double").alias(c) for c in features])
    long = wide.unpivot(["fold", "_y"], [f"`{c}`" for c in features], "model", "_x").filter("_x IS NOT NULL AND _y IS NOT NULL")
    x = F.col("_x")
    # Moments about a common point, so that differences of sums keep precision.
    means = long.groupBy("model").agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    dx, dy = x - F.col("mx"), y - F.col("my")
    centred = long.join(means, "model").select("model", "fold", "mx", "my", dx.alias("dx"), dy.alias("dy"))
    sums = {"n": F.count(F.lit(1)), "sx": F.sum("dx"), "sy": F.sum("dy"), "sxx": F.sum(F.col("dx") * F.col("dx")), "sxy": F.sum(F.col("dx") * F.col("dy"))}
    by_fold = centred.groupBy("model", "fold").agg(*[c.alias(k) for k, c in sums.items()])
    # (features x folds) rows from here on: all folds minus this one.
    all_folds = Window.partitionBy("model")
    rest = by_fold.select("model", "fold", *[(F.sum(k).over(all_folds) - F.col(k)).alias(k) for k in sums])
    n = F.when(F.col("n") > 0, F.col("n"))
    # A feature that is constant outside a fold fits the mean: slope 0.
    slope = F.coalesce(F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.col("sxx") - F.col("sx") * F.col("sx") / n), F.lit(0.0))
    lines = rest.select("model", "fold", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / n).alias("intercept"))
    scored = centred.join(lines, ["model", "fold"])
    error = F.col("dy") - F.col("intercept") - F.col("slope") * F.col("dx")
    mse = F.avg(error * error)
    return scored.groupBy("model", "fold").agg(F.sqrt(mse).alias("rmse"), (1 - F.try_divide(mse, F.var_pop("dy"))).alias("r2"))
