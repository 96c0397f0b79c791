"""Regression metrics and reports as single aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.nulls import col
from tabwright.functions.scalars import percent_error, residual
from tabwright.operators.quantiles import exact_quantiles


def metric_columns(label: Column, prediction: Column) -> dict[str, Column]:
    """rmse, mae, r2 and mse.  r2 is not defined for fewer than two rows (NULL);
    for a constant label it is 1 if all errors are 0 and else 0."""
    error = label - prediction
    mse = F.avg(error * error)
    spread = F.var_pop(label)
    defined = F.when(spread > 0, 1 - mse / spread).when(mse == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.count(error) >= 2, defined)
    return {"rmse": F.sqrt(mse), "mae": F.avg(F.abs(error)), "r2": r2, "mse": mse}


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by=()) -> DataFrame:
    columns = metric_columns(col(label).cast("double"), col(prediction))
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])


def metrics_on_both_scales(df: DataFrame, log_label: str, log_prediction: str) -> DataFrame:
    """Metrics of a model trained on log1p(y): on the log scale and on y."""
    y, p = col(log_label), col(log_prediction)
    log_scale = {f"{k}_log": c for k, c in metric_columns(y, p).items()}
    real = metric_columns(F.expm1(y), F.expm1(p))
    return df.agg(*[c.alias(k) for k, c in {**log_scale, **real}.items()])


def mean_over_folds(fold_scores: DataFrame, by=("model",)) -> DataFrame:
    """Average of the scores of the folds, not a score of the pooled rows."""
    return fold_scores.groupBy(*by).agg(F.avg("rmse").alias("cv_rmse"), F.avg("r2").alias("cv_r2"))


def predictions_report(df: DataFrame, label: str = "label", prediction: str = "prediction", keep=()) -> DataFrame:
    y, p = col(label).cast("double"), col(prediction)
    return df.select(
        *keep,
        y.alias("Actual"),
        p.alias("Predicted"),
        residual(y, p).alias("Residual"),
        F.abs(residual(y, p)).alias("Absolute_Error"),
        percent_error(y, p).alias("Percent_Error"),
    )


def residual_statistics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """mean, population std, min, max and quartiles of label - prediction."""
    return _report(df, label, prediction, None).select("residuals.*")


def model_report(
    df: DataFrame, model_name: str = "Model", label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    return _report(df, label, prediction, model_name)


def _report(df, label, prediction, model_name) -> DataFrame:
    y, p = col(label).cast("double"), col(prediction)
    errors = df.select(y.alias("y"), p.alias("p"), (y - p).alias("r"))
    q25, median, q75 = exact_quantiles(errors, {"r": [0.25, 0.5, 0.75]})["r"]
    r = F.col("r")
    return errors.agg(
        F.struct(*[c.alias(k) for k, c in metric_columns(F.col("y"), F.col("p")).items()]).alias("metrics"),
        F.struct(
            F.avg(r).alias("mean_residual"),
            F.stddev_pop(r).alias("std_residual"),
            F.min(r).alias("min_residual"),
            F.max(r).alias("max_residual"),
            F.lit(q25).cast("double").alias("q25_residual"),
            F.lit(median).cast("double").alias("median_residual"),
            F.lit(q75).cast("double").alias("q75_residual"),
        ).alias("residuals"),
        F.count(F.lit(1)).alias("predictions_count"),
        F.count_if(F.col("p") < F.col("y")).alias("underprediction_count"),
        F.count_if(F.col("p") > F.col("y")).alias("overprediction_count"),
    ).select(F.lit(model_name).alias("model_name"), "*")


def score_summary(df: DataFrame, price: str = "predicted_price", confidence: str = "confidence") -> DataFrame:
    return df.agg(
        F.count(col(price)).alias("n"),
        F.min(col(price)).alias("min_price"),
        F.max(col(price)).alias("max_price"),
        F.avg(col(price)).alias("avg_price"),
        F.avg(F.when(col(price).isNotNull(), col(confidence))).alias("avg_confidence"),
    )
