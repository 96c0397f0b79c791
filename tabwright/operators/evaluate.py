"""Cross-validated comparison and search over shared folds.

The features do not depend on the regressor, so they are fitted once per fold
and kept; every model and every trial reads the same folds.
"""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from tabwright import config
from tabwright.functions.nulls import col
from tabwright.operators.metrics import metric_columns
from tabwright.operators.models import NORMAL_EQUATION_FEATURES, TREE_KINDS, LabelStats, base_models, build, label_stats, n_features
from tabwright.operators.moments import LINEAR_KINDS, cross_validate_moments, second_moments
from tabwright.operators.prefixes import prefix_scores
from tabwright.session import ensure_checkpoint_dir, materialize

RESULT_SCHEMA = (
    "model string, cv_rmse double, cv_r2 double, test_rmse double, test_r2 double, status string, error string"
)
TRIAL_SCHEMA = "model string, trial int, params string, cv_rmse double, cv_r2 double, status string, error string"

# --- fixed values: search spaces (integers: low, high, step; floats: low, high) --
SEARCH_SPACES = {
    "RF": {
        "n_estimators": ("int", 600, 3000, 200),
        "max_depth": ("int", 3, 20, 1),
        "min_samples_split": ("int", 2, 20, 1),
        "min_samples_leaf": ("int", 1, 10, 1),
        "max_features": ("choice", ["sqrt", "log2", None]),
    },
    "Cat": {
        "n_estimators": ("int", 400, 3000, 500),
        "max_depth": ("int", 4, 10, 1),
        "learning_rate": ("log", 0.01, 0.1),
    },
    "XGB": {
        "n_estimators": ("int", 400, 3000, 500),
        "learning_rate": ("log", 0.01, 0.1),
        "max_depth": ("int", 3, 7, 1),
        "subsample": ("float", 0.6, 0.9),
        "colsample": ("float", 0.6, 0.9),
    },
    "LGBM": {
        "n_estimators": ("int", 400, 3000, 500),
        "learning_rate": ("log", 0.01, 0.1),
        "num_leaves": ("int", 20, 150, 1),
        "max_depth": ("int", 3, 12, 1),
        "subsample": ("float", 0.6, 0.9),
        "colsample": ("float", 0.6, 0.9),
    },
    "Ridge": {"alpha": ("log", 1e-3, 100.0)},
    "Lasso": {"alpha": ("log", 1e-3, 100.0)},
    "ENet": {"alpha": ("log", 1e-3, 100.0), "l1_ratio": ("float", 0.1, 0.9)},
}
# --- end of fixed values ---------------------------------------------------------


@dataclass
class Part:
    """Rows to fit on and rows to score, with their feature vectors."""

    train: DataFrame
    valid: DataFrame
    stats: LabelStats
    width: int
    kept: DataFrame

    def release(self) -> None:
        self.kept.unpersist()


def make_part(rows: DataFrame, is_train, transform, keep, label: str = "label", storage: str = "memory") -> Part:
    """Transform all rows with features fitted on the ``is_train`` ones and keep
    the vectors: in executor memory and disk, or as a table in the shared folder."""
    vectors = transform(rows).select(*keep, label, is_train.alias("_train"), "features")
    kept = materialize(vectors, "fold") if storage == "table" else vectors.persist(StorageLevel.MEMORY_AND_DISK)
    train, valid = kept.filter("_train").drop("_train"), kept.filter("NOT _train").drop("_train")
    return Part(train, valid, label_stats(train, label), n_features(train), kept)


def prepare_folds(
    df: DataFrame, fit_transform, row_id: str, k: int = config.CV_FOLDS, fold: str = "fold", label: str = "label", storage="memory"
) -> list[Part]:
    """``fit_transform(train_rows)`` returns the function that adds ``features``."""
    parts = []
    for i in range(k):
        transform = fit_transform(df.filter(col(fold) != i).drop(fold))
        parts.append(make_part(df, col(fold) != i, transform, [row_id], label, storage))
    return parts


def _in_parallel(spark, jobs, parallelism: int):
    """Submit Spark jobs from driver threads; local properties are inherited."""
    if parallelism <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs]))


def _score(model, rows: DataFrame, label: str) -> dict:
    c = metric_columns(col(label), F.col("prediction"))
    return model.transform(rows).agg(c["rmse"].alias("rmse"), c["r2"].alias("r2"), c["mae"].alias("mae")).first().asDict()


def fit_part(kind: str, params: dict, part: Part, label: str = "label", seed: int = config.SEED):
    return build(kind, params, part.stats, part.width, label=label, seed=seed).fit(part.train)


def cross_validate(kind: str, params: dict, parts: list[Part], label: str = "label", seed: int = config.SEED) -> dict:
    scores = [_score(fit_part(kind, params, p, label, seed), p.valid, label) for p in parts]
    return {f"cv_{m}": sum(s[m] for s in scores) / len(scores) for m in ("rmse", "r2")}


def cross_validate_counts(kind: str, params: dict, counts, parts: list[Part], label: str = "label", seed: int = config.SEED) -> dict[int, dict]:
    """``cross_validate`` of an ensemble for several numbers of trees, from one fit a fold, of the most trees."""
    wanted, totals = sorted(set(counts)), {}
    for part in parts:
        model = fit_part(kind, {**params, "n_estimators": wanted[-1]}, part, label, seed)
        for r in prefix_scores(model, part.valid, label).filter(F.col("n_estimators").isin(wanted)).collect():  # a row a count
            totals.setdefault(r["n_estimators"], []).append((r["rmse"], r["r2"]))
    return {n: {f"cv_{m}": sum(s[i] for s in scores) / len(parts) for i, m in enumerate(("rmse", "r2"))} for n, scores in totals.items()}


def evaluate_models(
    models: dict, parts: list[Part], final: Part, row_id: str, label: str = "label", parallelism: int = 1, seed: int = config.SEED
) -> tuple[DataFrame, DataFrame | None, dict]:
    """(results, predictions, fitted models).  A model that fails becomes a row
    with status 'fail'; predictions are long: (model, row_id, prediction)."""
    spark = final.train.sparkSession
    ensure_checkpoint_dir(spark)
    fitted = {}

    def job(name, kind, params):
        def run():
            try:
                cv = cross_validate(kind, params, parts, label, seed)
                model = fit_part(kind, params, final, label, seed)
                test = _score(model, final.valid, label)
                fitted[name] = model
                return (name, cv["cv_rmse"], cv["cv_r2"], test["rmse"], test["r2"], "ok", None)
            except Exception as e:  # one failing model must not end the comparison
                return (name, None, None, None, None, "fail", str(e))

        return run

    rows = _in_parallel(spark, [job(n, k, p) for n, (k, p) in models.items()], parallelism)
    predictions = None
    for name in models:
        if name in fitted:
            one = fitted[name].transform(final.valid).select(F.lit(name).alias("model"), col(row_id), "prediction")
            predictions = one if predictions is None else predictions.unionByName(one)
    return spark.createDataFrame(rows, RESULT_SCHEMA), predictions, fitted


def sample_params(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, (kind, *spec) in space.items():
        if kind == "int":
            low, high, step = spec
            out[name] = low + step * rng.randint(0, (high - low) // step)
        elif kind == "float":
            out[name] = rng.uniform(*spec)
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(spec[0]), math.log(spec[1])))
        else:
            out[name] = rng.choice(spec[0])
    return out


def trial_params(name: str, n_trials: int, seed: int, spaces=None) -> list[dict]:
    space = (spaces or SEARCH_SPACES).get(name)
    if space is None:
        raise ValueError(f"model {name} has no search space")
    return [sample_params(space, random.Random(f"{seed}:{name}:{i}")) for i in range(n_trials)]


def tune_models(
    names,
    parts: list[Part],
    n_trials: int = config.SEARCH_TRIALS,
    seed: int = config.SEED,
    models: dict | None = None,
    spaces: dict | None = None,
    label: str = "label",
    parallelism: int = 1,
    every_tree_count: bool = False,
) -> tuple[dict, DataFrame]:
    """Seeded random search, minimising the CV RMSE.  Returns
    {name: {best_params, best_cv_rmse}} and the table of all trials.

    All trials of the linear models share one pass over each fold: its second moments.  With ``every_tree_count`` a trial of an
    ensemble is fitted once a fold with the most trees of its search space, and takes the best of all numbers of trees there."""
    models, spaces_of = models or base_models(), spaces or SEARCH_SPACES
    spark = parts[0].train.sparkSession
    ensure_checkpoint_dir(spark)
    searched = [n for n in names if n in models and n in (spaces or SEARCH_SPACES)]
    from_moments = {n for n in searched if models[n][0] in LINEAR_KINDS and all(p.width <= NORMAL_EQUATION_FEATURES for p in parts)}
    folds = []
    if from_moments:
        folds = _in_parallel(spark, [lambda p=p: second_moments(p.kept, "_train", label=label) for p in parts], parallelism)

    def job(name, trial, drawn):
        def run():
            (kind, base), params = models[name], drawn
            try:
                if every_tree_count and kind in TREE_KINDS and "n_estimators" in spaces_of[name]:
                    _, low, high, step = spaces_of[name]["n_estimators"]
                    scores = cross_validate_counts(kind, {**base, **params}, range(low, high + 1, step), parts, label, seed)
                    best = min(scores, key=lambda n: (scores[n]["cv_rmse"], n))
                    params, cv = {**params, "n_estimators": best}, scores[best]
                elif name in from_moments:
                    cv = cross_validate_moments(kind, {**base, **params}, folds)
                else:
                    cv = cross_validate(kind, {**base, **params}, parts, label, seed)
                return (name, trial, json.dumps(params), cv["cv_rmse"], cv["cv_r2"], "ok", None)
            except Exception as e:
                return (name, trial, json.dumps(params), None, None, "fail", str(e))

        return run

    rows, jobs = [], []
    for name in names:
        if name not in searched:
            rows.append((name, None, None, None, None, "skipped", "no model or no search space of this name"))
            continue
        jobs += [job(name, i, p) for i, p in enumerate(trial_params(name, n_trials, seed, spaces))]
    rows += _in_parallel(spark, jobs, parallelism)
    tuned: dict = {}
    for name, trial, params, rmse, _, status, _ in rows:
        if status == "ok" and (name not in tuned or rmse < tuned[name]["best_cv_rmse"]):
            tuned[name] = {"best_params": json.loads(params), "best_cv_rmse": rmse, "trial": trial}
    return tuned, spark.createDataFrame(rows, TRIAL_SCHEMA)
