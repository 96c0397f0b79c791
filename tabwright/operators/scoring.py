"""Scoring of rows with error isolation; works on batches and streams."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from tabwright import config
from tabwright.functions.nulls import col
from tabwright.operators.explain import Explainer, explain_topk, original_values
from tabwright.operators.projection import align_columns, enforce_schema, rename_aliases, validation_error

ORIGINALS = "_originals"


def check_records(df: DataFrame, fields: dict[str, str] | None = None, required=(), aliases=config.ALIASES) -> DataFrame:
    """Rename aliases, cast to the declared types and put the first problem of
    a row into ``error``.  No row is dropped and none stops the job."""
    named = rename_aliases(df, aliases)
    typed = enforce_schema(named, fields or config.data_schema_fields())
    return typed.withColumn("error", F.coalesce(F.col("error"), validation_error(typed.columns, required)))


def with_prediction_result(df: DataFrame, model_name: str, confidence: float = config.CONFIDENCE) -> DataFrame:
    """predicted_price, confidence, model_name and error from prediction + error."""
    p = F.col("prediction")
    problem = F.coalesce(F.col("error"), F.when(p.isNull() | F.isnan(p), F.lit("no prediction for this record")))
    ok = problem.isNull()
    return df.withColumns(
        {
            "predicted_price": F.when(ok, p),
            "confidence": F.when(ok, F.lit(confidence)).otherwise(F.lit(0.0)),
            "model_name": F.lit(model_name),
            "error": problem,
        }
    )


def predict_rows(df: DataFrame, model: PipelineModel, expected: dict[str, str], required=(), fields=None, aliases=config.ALIASES) -> DataFrame:
    """One pass over all rows: checks, features, prediction.  The values before
    any transformation stay in a map column for explanations."""
    checked = check_records(df, fields, required, aliases)
    raw = [c for c in checked.columns if c in (fields or config.data_schema_fields())]
    kept = checked.withColumn(ORIGINALS, original_values(checked, raw))
    return model.transform(align_columns(kept, expected))


def score(
    df: DataFrame, model: PipelineModel, expected: dict[str, str], model_name: str, keep=(), required=(), fields=None, aliases=config.ALIASES
) -> DataFrame:
    rows = with_prediction_result(predict_rows(df, model, expected, required, fields, aliases), model_name)
    return rows.select(*[col(c) for c in keep], "predicted_price", "confidence", "model_name", "error")


def score_explain(
    df: DataFrame,
    model: PipelineModel,
    explainer: Explainer,
    expected: dict[str, str],
    model_name: str,
    top_k: int = config.TOP_CONTRIBUTIONS,
    keep=(),
    required=(),
    fields=None,
    aliases=config.ALIASES,
) -> DataFrame:
    """Score plus the k largest contributions of each row."""
    rows = with_prediction_result(predict_rows(df, model, expected, required, fields, aliases), model_name)
    explained = explain_topk(explainer.explain(rows), explainer.slots(), top_k, originals=F.col(ORIGINALS))
    ok = F.col("error").isNull()
    return explained.select(
        *[col(c) for c in keep],
        "predicted_price",
        "confidence",
        "model_name",
        "error",
        F.when(ok, F.lit(explainer.base)).alias("base_value"),
        F.when(ok, F.col("explanations")).alias("explanations"),
    )


def batch_response(scored: DataFrame, order: Column | str, by) -> DataFrame:
    """One row per request body: its successful predictions in input order and
    the number of records looked at.  ``by`` identifies the body, so a group is
    never larger than the single input row it was exploded from.  A job that
    scores a table writes rows and does not need this."""
    result = F.struct(F.col("predicted_price"), F.col("confidence"), F.col("model_name"))
    key = F.col(order) if isinstance(order, str) else order
    rows = F.collect_list(F.when(F.col("error").isNull(), F.struct(key.alias("k"), result.alias("r"))))
    return scored.groupBy(*by).agg(
        F.transform(F.array_sort(rows), lambda x: x["r"]).alias("predictions"),
        F.count(F.lit(1)).alias("total_processed"),
    )


def numbered(scored: DataFrame, position: str, keep=(), errors: bool = False) -> DataFrame:
    """Result rows with a 1-based number taken from the input position; with ``errors`` also why a row has no price."""
    return scored.select(
        (F.col(position) + 1).alias("No"),
        *[col(c) for c in keep],
        F.col("predicted_price").alias("Predicted Price"),
        F.col("confidence").alias("Confidence"),
        F.col("model_name").alias("Model"),
        *([F.col("error").alias("Error")] if errors else []),
    )
