"""Scoring of a stream of requests.  Every step is row-wise, so there is no
state and no watermark; the same functions serve batches."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tabwright import config
from tabwright.functions.nulls import col
from tabwright.operators.explain import Explainer
from tabwright.operators.scoring import score, score_explain
from tabwright.sources.readers import explode_batches, request_schema, spoiled_batches


def read_request_stream(spark: SparkSession, path: str, fmt: str = "json", schema=None, max_files: int | None = None) -> DataFrame:
    """One request record per line (json) or per row (parquet, csv)."""
    reader = spark.readStream.format(fmt).schema(schema or request_schema())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def score_stream(requests: DataFrame, model: PipelineModel, expected: dict[str, str], model_name: str, keep=(), **checks) -> DataFrame:
    return score(requests, model, expected, model_name, keep, **checks)


def write_scores(scored: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Parquet sink; progress and file log make each row appear once even if
    executors or the driver are lost.  Progress is kept below the sink unless another
    folder is given: both logs number the same batches, so a later start with the same
    sink goes on after the last one."""
    writer = (
        scored.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or f"{path.rstrip('/')}/_progress")
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_body_stream(spark: SparkSession, path: str, schema: str = "request_id string, body string", fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """One request per row: its id and its JSON body ``{"houses": [record, ...]}``."""
    return read_request_stream(spark, path, fmt, schema, max_files)


def score_bodies(
    bodies: DataFrame,
    model: PipelineModel,
    expected: dict[str, str],
    model_name: str,
    key: str = "request_id",
    body: str = "body",
    fields: dict[str, str] | None = None,
    explainer: Explainer | None = None,
    top_k: int = config.TOP_CONTRIBUTIONS,
    **checks,
) -> DataFrame:
    """One row per record of each body with its place in it, and one row without a place for a body that has no list of records.
    ``error`` says why a row has no price.  With an ``explainer`` rows have their largest contributions."""
    rows = explode_batches(bodies, body, fields, keep=(key,))
    named = {"keep": (key, "position"), **checks, **({"fields": fields} if fields else {})}
    if explainer is None:
        scored = score(rows, model, expected, model_name, **named)
    else:
        scored = score_explain(rows, model, explainer, expected, model_name, top_k, **named)
    spoiled = spoiled_batches(bodies, body, keep=(key,))
    refused = spoiled.select(key, F.lit(0.0).alias("confidence"), F.lit(model_name).alias("model_name"), "error")
    return scored.unionByName(refused, allowMissingColumns=True)


def write_bodies(
    bodies: DataFrame, scored_by, results: str, rejects: str, checkpoint: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Two sinks for a stream of request bodies: rows with a price go to ``results``, the others with their reason to ``rejects``.

    ``scored_by`` takes the bodies of a batch and gives their scored rows (see ``score_bodies``).  A batch has a folder of its own,
    ``batch=<number>``, in each sink and replaces what stands there.  A batch that was cut short anywhere, also between the two
    writes, is written again whole by the next start, so no row is lost or repeated.  Read a sink as a parquet table."""

    def write(batch: DataFrame, number: int) -> None:
        rows = scored_by(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ok = col("error").isNull()
            rows.filter(ok).drop("error").write.mode("overwrite").parquet(f"{results.rstrip('/')}/batch={number}")
            wrong = [c for c in rows.columns if c not in ("predicted_price", "confidence", "base_value", "explanations")]
            rows.filter(~ok).select(*[col(c) for c in wrong]).write.mode("overwrite").parquet(f"{rejects.rstrip('/')}/batch={number}")
        finally:
            rows.unpersist()

    writer = bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{results.rstrip('/')}/_progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
