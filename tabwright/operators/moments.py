"""Linear models from second moments: every penalty of a search is fitted and scored without another pass over the rows.

One pass over the rows of a fold gives the sums of all products of (1, features, label), apart for the rows to fit on and the rows to score.
A ridge, lasso or elastic-net model needs no more than that, and neither do its squared errors on the rows to score.
The sums are as large as the square of the number of features, whatever the number of rows; they are made per partition and added up
row by row of the matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.nulls import col

LINEAR_KINDS = ("ridge", "lasso", "elastic_net", "linear")
MOST_ROUNDS, STEP_LIMIT = 20_000, 1e-13
ROW = "fitted boolean, at int, sums array<double>"


@dataclass
class Moments:
    """Sums of products of (1, features, label), the last two less ``shift``."""

    sums: np.ndarray

    @property
    def rows(self) -> float:
        return self.sums[0, 0]

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scatter of the features, its products with the label, and the means of features and label."""
        means = self.sums[0, 1:] / self.rows
        scatter = self.sums[1:, 1:] - self.rows * np.outer(means, means)
        return scatter[:-1, :-1], scatter[:-1, -1], means


def second_moments(rows: DataFrame, fitted: str, features: str = "features", label: str = "label") -> dict[bool, Moments]:
    """Moments of the rows with ``fitted`` and of those without it.  Values are shifted by the means of all rows, so that their squares do
    not swallow their differences."""
    vectors = rows.select(col(fitted).alias("fitted"), array_to_vector(F.concat(vector_to_array(col(features)), F.array(col(label).cast("double")))).alias("v"))
    means = vectors.agg(Summarizer.mean(F.col("v"))).first()[0].toArray()

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[bool, np.ndarray] = {}
        for frame in frames:
            for kind, part in frame.groupby("fitted")["v"]:
                z = np.column_stack([np.ones(len(part)), np.stack(part.to_numpy()) - means])
                totals[kind] = totals.get(kind, 0) + z.T @ z
        for kind, total in totals.items():
            yield pd.DataFrame({"fitted": kind, "at": np.arange(len(total)), "sums": list(total)})

    parts = vectors.select("fitted", vector_to_array("v").alias("v")).mapInPandas(partial, ROW)
    added = parts.groupBy("fitted", "at").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    size = len(means) + 1
    found: dict[bool, Moments] = {kind: Moments(np.zeros((size, size))) for kind in (True, False)}
    for r in added.collect():
        found[r["fitted"]].sums[r["at"]] = r["sums"].toArray()
    return found


def coordinate_descent(scatter: np.ndarray, products: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Minimises w' S w / 2 - p' w + l1 |w| + l2 w' w / 2, one coordinate at a time, until no step changes a coefficient."""
    w, gradient = np.zeros(len(products)), -products.astype(float)
    diagonal = np.diag(scatter)
    for _ in range(MOST_ROUNDS):
        largest = 0.0
        for j in np.flatnonzero(diagonal > 0):
            pull = diagonal[j] * w[j] - gradient[j]
            new = math.copysign(max(abs(pull) - l1, 0.0), pull) / (diagonal[j] + l2)
            if new != w[j]:
                gradient += scatter[:, j] * (new - w[j])
                largest = max(largest, abs(new - w[j]) / max(1.0, abs(new)))
                w[j] = new
        if largest <= STEP_LIMIT:
            break
    return w


def fit_moments(kind: str, params: dict, moments: Moments) -> tuple[np.ndarray, float]:
    """Coefficients, and the intercept in shifted values.  The intercept has no penalty."""
    scatter, products, means = moments.centred()
    alpha, n = float(params.get("alpha", 0.0)), moments.rows
    if kind == "linear":
        w = np.linalg.lstsq(scatter, products, rcond=None)[0]
    elif kind == "ridge":  # alpha weighs the sum of the squares
        w = np.linalg.lstsq(scatter + alpha * np.eye(len(products)), products, rcond=None)[0]
    else:  # alpha weighs the mean of the squares, halved
        share = 1.0 if kind == "lasso" else float(params.get("l1_ratio", 0.5))
        w = coordinate_descent(scatter / n, products / n, alpha * share, alpha * (1 - share))
    return w, means[-1] - means[:-1] @ w


def score_moments(w: np.ndarray, intercept: float, moments: Moments) -> dict[str, float]:
    error = np.concatenate(([-intercept], -w, [1.0]))  # label - intercept - w x
    n, (_, _, means) = moments.rows, moments.centred()
    mse = max(0.0, float(error @ moments.sums @ error / n))
    spread = float(moments.sums[-1, -1] / n - means[-1] ** 2)
    return {"rmse": math.sqrt(mse), "r2": 1 - mse / spread if spread > 0 else float(mse == 0)}


def cross_validate_moments(kind: str, params: dict, folds: list[dict[bool, Moments]]) -> dict[str, float]:
    scores = [score_moments(*fit_moments(kind, params, fold[True]), fold[False]) for fold in folds]
    return {f"cv_{m}": sum(s[m] for s in scores) / len(scores) for m in ("rmse", "r2")}
