"""Score files end to end: read, check, defaults, score, summary, sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright import config
from tabwright.functions.nulls import col
from tabwright.operators.metrics import score_summary
from tabwright.operators.profile import histogram
from tabwright.operators.projection import keep_successful, merge_defaults, normalize_records, validate_batch
from tabwright.operators.scoring import batch_response, numbered, score, score_explain
from tabwright.plans.training import SavedModel
from tabwright.sources.readers import read_batch_csv, read_json_batches, with_position
from tabwright.sources.sinks import write_csv


@dataclass
class ScoredBatch:
    scored: DataFrame
    successful: DataFrame
    summary: DataFrame
    check: dict


def score_frame(
    records: DataFrame, model: SavedModel, max_rows: int | None = None, defaults=config.RECORD_DEFAULTS, keep=(), fill_nulls=False
) -> ScoredBatch:
    check = validate_batch(records, max_rows)
    if not check["valid"]:
        raise ValueError(check["error"])
    merged = merge_defaults(normalize_records(records), defaults, fill_nulls=fill_nulls)
    scored = score(merged, model.pipeline, model.expected, model.name, keep)
    return ScoredBatch(scored, keep_successful(scored), score_summary(scored), check)


def score_csv(spark: SparkSession, source: str, target: str | None, model: SavedModel, max_rows: int | None = None, keep=()) -> ScoredBatch:
    """Score a CSV file.  Every input row has a result row with its number in the input, the columns named in ``keep``, and the
    reason where it has no price."""
    records = with_position(read_batch_csv(spark, source))
    batch = score_frame(records, model, max_rows, keep=["position", *keep])
    if target is not None:
        write_csv(numbered(batch.scored, "position", keep, errors=True), target)
    return batch


def score_json(spark: SparkSession, source: str, model: SavedModel, explain: bool = False, top_k: int = config.TOP_CONTRIBUTIONS) -> DataFrame:
    records = read_json_batches(spark, source)
    if explain:
        return score_explain(records, model.pipeline, model.explainer, model.expected, model.name, top_k, ["source", "position"])
    return score(records, model.pipeline, model.expected, model.name, ["source", "position"])


def write_json_responses(scored: DataFrame, path: str) -> None:
    """One JSON response per request body: its predictions in input order and how many records it had."""
    response = batch_response(scored, "position", ["source"])
    response.select(F.to_json(F.struct("source", "predictions", "total_processed")).alias("value")).write.mode("overwrite").text(path)


def score_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(scored.filter(col("error").isNull()), "predicted_price", bins)
