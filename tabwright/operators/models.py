"""The model zoo: Spark regressors under one parameter vocabulary.

Parameters keep the customary names (``n_estimators``, ``learning_rate``,
``alpha`` ...) and are translated to Spark's in ``build``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tabwright import config
from tabwright.functions.nulls import col

DEEPEST_TREE = 30  # Spark's limit; stands for "no limit"
NORMAL_EQUATION_FEATURES = 4096  # Spark's limit for the one-pass solver

# --- fixed values: base models ------------------------------------------------
BASE_MODELS = {
    "RF": ("forest", {"n_estimators": 500, "max_features": "sqrt", "max_depth": None}),
    "ENet": ("elastic_net", {"alpha": 0.01, "l1_ratio": 0.5, "max_iter": 20000}),
    "Ridge": ("ridge", {"alpha": 10.0, "max_iter": 20000}),
    "Lasso": ("lasso", {"alpha": 0.0005, "max_iter": 20000}),
    "XGB": ("boosting", {"n_estimators": 2000, "learning_rate": 0.03, "max_depth": 4, "subsample": 0.8, "colsample": 0.8}),
    "Cat": ("boosting", {"n_estimators": 1000, "learning_rate": 0.05, "max_depth": 6}),
    "LGBM": ("boosting", {"n_estimators": 2000, "learning_rate": 0.03, "num_leaves": 31}),
}
# --- end of fixed values ------------------------------------------------------

TREE_KINDS = ("forest", "boosting")


@dataclass(frozen=True)
class LabelStats:
    """What the penalty scale of the linear models depends on."""

    rows: int
    deviation: float  # population


def label_stats(df: DataFrame, label: str = "label") -> LabelStats:
    row = df.agg(F.count(col(label)), F.stddev_pop(col(label))).first()
    return LabelStats(row[0], row[1] or 1.0)


def base_models(overrides: dict[str, dict] | None = None, names=None) -> dict[str, tuple[str, dict]]:
    """{name: (kind, parameters)}; ``overrides`` changes parameters by model."""
    overrides = overrides or {}
    return {
        name: (kind, {**params, **overrides.get(name, {})})
        for name, (kind, params) in BASE_MODELS.items()
        if names is None or name in names
    }


def build(
    kind: str,
    params: dict,
    stats: LabelStats,
    n_features: int,
    label: str = "label",
    features: str = "features",
    seed: int = config.SEED,
):
    columns = {"labelCol": label, "featuresCol": features, "predictionCol": "prediction"}
    if kind in ("ridge", "lasso", "elastic_net", "linear"):
        solver = _solver(params, n_features)
        return LinearRegression(**columns, **_penalty(kind, params, stats, solver["solver"]), **solver)
    if kind == "forest":
        return RandomForestRegressor(
            **columns,
            numTrees=params["n_estimators"],
            maxDepth=_depth(params),
            featureSubsetStrategy={None: "all"}.get(params.get("max_features"), params.get("max_features")),
            minInstancesPerNode=_leaf_size(params),
            maxBins=params.get("max_bins", 64),
            seed=seed,
        )
    if kind == "boosting":
        return GBTRegressor(
            **columns,
            maxIter=params["n_estimators"],
            stepSize=params["learning_rate"] / 2,  # Spark fits its trees to twice the residual
            maxDepth=_boosting_depth(params),
            subsamplingRate=params.get("subsample", 1.0),
            featureSubsetStrategy=str(params["colsample"]) if params.get("colsample", 1.0) < 1 else "all",
            maxBins=params.get("max_bins", 64),
            checkpointInterval=10,
            seed=seed,
        )
    raise ValueError(f"unknown kind of model: {kind}")


def _penalty(kind: str, params: dict, stats: LabelStats, solver: str) -> dict:
    """Spark fits label / deviation, so an L2 penalty is divided by the
    deviation of the label while an L1 penalty is not.  These factors undo it.
    The one-pass solver takes the population deviation, the other the sample's."""
    alpha, d = float(params.get("alpha", 0.0)), stats.deviation
    if solver != "normal" and stats.rows > 1:
        d *= math.sqrt(stats.rows / (stats.rows - 1))
    if kind == "linear":
        l1 = l2 = 0.0
    elif kind == "ridge":  # alpha weighs the sum, not the mean, of the squares
        l1, l2 = 0.0, alpha * d / max(stats.rows, 1)
    elif kind == "lasso":
        l1, l2 = alpha, 0.0
    else:
        share = float(params.get("l1_ratio", 0.5))
        l1, l2 = alpha * share, alpha * (1 - share) * d
    total = l1 + l2
    return {"regParam": total, "elasticNetParam": l1 / total if total else 0.0, "standardization": False}


def _solver(params: dict, n_features: int) -> dict:
    # The normal equations need one pass over the rows, whatever the number of
    # iterations for the L1 part, because those run on the d x d matrix.
    solver = params.get("solver") or ("normal" if n_features <= NORMAL_EQUATION_FEATURES else "l-bfgs")
    return {"solver": solver, "maxIter": int(params.get("max_iter", 20000)), "tol": 1e-14}


def _leaf_size(params: dict) -> int:
    # A node smaller than min_samples_split stays whole: no two children of at
    # least half that size fit into it.
    return max(params.get("min_samples_leaf", 1), math.ceil(params.get("min_samples_split", 2) / 2))


def _depth(params: dict) -> int:
    depth = params.get("max_depth") or DEEPEST_TREE
    if depth > DEEPEST_TREE:
        raise ValueError(f"trees deeper than {DEEPEST_TREE} levels are not possible: {depth}")
    return depth


def _boosting_depth(params: dict) -> int:
    depth = _depth(params)
    return min(depth, math.ceil(math.log2(params["num_leaves"]))) if params.get("num_leaves") else depth


def n_features(df: DataFrame, features: str = "features") -> int:
    """Width of the vector column, from its metadata or one row."""
    size = df.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if size is not None:
        return size
    row = df.select(features).first()
    return 0 if row is None else row[0].size
