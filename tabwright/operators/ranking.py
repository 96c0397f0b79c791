"""Ranking of model results.  These tables hold one row per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rank_models(results: DataFrame, by: str = "cv_rmse") -> DataFrame:
    """Successful models, best first; a tie is broken by name."""
    return results.filter(F.col("status") == "ok").orderBy(by, "model")


def top_models(results: DataFrame, k: int = 5, by: str = "cv_rmse") -> list[str]:
    return [r["model"] for r in rank_models(results, by).limit(k).collect()]


def best_model(results: DataFrame, by: str = "cv_rmse") -> str | None:
    ok = results.filter(F.col("status") == "ok")
    return ok.agg(F.min_by("model", F.struct(F.col(by), F.col("model")))).first()[0]


def final_ranking(baseline: DataFrame, name: str, test_rmse: float, test_r2: float) -> DataFrame:
    """Baseline rows and one row '<name> (Tuned)', by test RMSE."""
    tuned = baseline.sparkSession.createDataFrame(
        [(f"{name} (Tuned)", float(test_rmse), float(test_r2))], "model string, test_rmse double, test_r2 double"
    )
    return baseline.select("model", "test_rmse", "test_r2").unionByName(tuned).orderBy("test_rmse", "model")
