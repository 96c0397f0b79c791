"""The training job: split, features, comparison, search, final model."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tabwright import config as defaults
from tabwright.config import TableConfig
from tabwright.functions.nulls import col
from tabwright.operators.evaluate import evaluate_models, fit_part, make_part, prepare_folds, tune_models
from tabwright.operators.explain import Explainer, feature_importance, mean_abs_shap
from tabwright.operators.metrics import model_report, predictions_report, regression_metrics
from tabwright.operators.models import TREE_KINDS, base_models
from tabwright.operators.profile import target_summary
from tabwright.operators.projection import separate_target
from tabwright.operators.ranking import final_ranking, rank_models, top_models
from tabwright.operators.split import add_folds, exact_split, hash_split
from tabwright.plans.feature_space import expected_columns, feature_names, fit_feature_space
from tabwright.session import apply_runtime_settings, materialize
from tabwright.sources.sinks import RunLog, model_card, write_csv, write_model_card, write_table

LABEL = "label"
DOMAIN_FEATURES = [
    "TotalSF", "TotalBath", "HouseAge", "RemodAge", "IsRemodeled", "Has2ndFlr", "TotalPorchSF",
    "Quality_Area_Interaction", "MoSold_sin", "MoSold_cos", "Loc_Type", "LotArea_clip",
]


# --- fixed values: models to tune, in this order, when no comparison has ranked them ---
UNRANKED_ORDER = ("XGB", "Cat", "LGBM", "RF", "Ridge")
# --- end of fixed values ---


@dataclass
class TrainedModel:
    name: str
    kind: str
    params: dict
    pipeline: PipelineModel
    features: PipelineModel
    names: DataFrame
    expected: dict
    explainer: Explainer
    results: DataFrame | None
    ranking: DataFrame | None
    trials: DataFrame | None
    metrics: dict
    report: DataFrame = field(default=None)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/model")
        self.features.write().overwrite().save(f"{path}/features")
        self.explainer.save(f"{path}/explainer")
        spark = self.names.sparkSession
        meta = json.dumps({"name": self.name, "kind": self.kind, "params": self.params, "expected": self.expected})
        write_table(spark.createDataFrame([(meta,)], "meta string"), f"{path}/about")


@dataclass
class SavedModel:
    name: str
    pipeline: PipelineModel
    expected: dict
    explainer: Explainer


def load_model(spark, path: str) -> SavedModel:
    meta = json.loads(spark.read.parquet(f"{path}/about").first()["meta"])
    return SavedModel(
        meta["name"], PipelineModel.load(f"{path}/model"), meta["expected"], Explainer.load(spark, f"{path}/explainer")
    )


def prepare(df: DataFrame, table: TableConfig, test_size=defaults.TEST_SIZE, seed=defaults.SEED, exact=False, k=defaults.CV_FOLDS):
    """Label, split and fold columns; the row id stays outside the features."""
    labelled = separate_target(df, table.target, LABEL)
    split = (exact_split if exact else hash_split)(labelled, table.row_id, test_size, seed)
    return add_folds(split, table.row_id, k, seed)


def train_model(
    df: DataFrame,
    table: TableConfig | None = None,
    models: dict | None = None,
    run_baseline: bool = True,
    run_tuning: bool = True,
    n_trials: int = defaults.SEARCH_TRIALS,
    top_models_to_tune: int = defaults.SEARCH_TOP_MODELS,
    k: int = defaults.CV_FOLDS,
    seed: int = defaults.SEED,
    test_size: float = defaults.TEST_SIZE,
    exact_test_size: bool = False,
    route_on_test: bool = False,
    spaces: dict | None = None,
    parallelism: int = 1,
    storage: str = "memory",
    output: str | None = None,
) -> TrainedModel:
    table = table or TableConfig()
    models = models or base_models()
    spark = apply_runtime_settings(df.sparkSession)
    log = RunLog(spark, None if output is None else f"{output}/run_metrics", "training")
    # Every feature stage reads the rows again: keep them once, with their split.
    prepared = prepare(df, table, test_size, seed, exact_test_size, k)
    data = materialize(prepared, "training") if storage == "table" else prepared.persist(StorageLevel.MEMORY_AND_DISK)
    for r in target_summary(data, LABEL).collect():
        log.metrics(**{f"{r['split']}_size": r["n"], f"{r['split']}_mean": r["mean"], f"{r['split']}_std": r["std"]})

    def fit_transform(rows):
        return fit_feature_space(rows, table, LABEL).transform

    is_train = col("split") == "train"
    train = data.filter(is_train).drop("split")
    held_out = data.filter(~is_train).drop("split", "fold") if route_on_test else None
    features = fit_feature_space(train.drop("fold"), table, LABEL, test=held_out)
    final = make_part(data, is_train, features.transform, [table.row_id], LABEL, storage)
    names = feature_names(features)

    results = trials = ranking = None
    tuned: dict = {}
    parts = []
    try:
        if run_baseline or run_tuning:
            parts = prepare_folds(train, fit_transform, table.row_id, k, "fold", LABEL, storage)
        if run_baseline:
            results, _, _ = evaluate_models(models, parts, final, table.row_id, LABEL, parallelism, seed)
            ranked = rank_models(results)
            top = top_models(results, top_models_to_tune)
            log.child("baseline").params(top=top)
        else:
            top = [m for m in UNRANKED_ORDER if m in models][:top_models_to_tune]
        if run_tuning:
            tuned, trials = tune_models(top, parts, n_trials, seed, models, spaces, LABEL, parallelism)
        if tuned:
            name = min(tuned, key=lambda m: (tuned[m]["best_cv_rmse"], m))
        elif top and run_baseline:
            name = top[0]
        else:
            raise RuntimeError("no model to select: neither a baseline nor a search has a result")
    finally:
        for p in parts:
            p.release()

    kind, base = models[name]
    params = {**base, **tuned.get(name, {}).get("best_params", {})}
    model = fit_part(kind, params, final, LABEL, seed)
    predicted = model.transform(final.valid)
    metrics = regression_metrics(predicted, LABEL).first().asDict()
    final_log = log.child("final")
    final_log.params(model=name, **params)
    final_log.metrics(**metrics)
    if results is not None:
        ranking = final_ranking(results.filter("status = 'ok'"), name, metrics["rmse"], metrics["r2"]) if tuned else ranked
    trained = TrainedModel(
        name, kind, params, PipelineModel([features, model]), features, names, expected_columns(features),
        Explainer.fit(model, final.train, names, table.row_id, seed=seed), results, ranking, trials, metrics,
        predictions_report(predicted, LABEL, keep=[col(table.row_id)]),
    )
    if output is not None:
        trained.save(output)
        write_table(trained.report, f"{output}/predictions")
        write_table(model_report(predicted, name, LABEL), f"{output}/model_report")
        if kind in TREE_KINDS:
            write_table(feature_importance(model, names, top=None), f"{output}/importance")
        else:
            explained = trained.explainer.explain(model.transform(final.train))
            write_table(mean_abs_shap(explained, trained.explainer.slots()), f"{output}/importance")
        if results is not None:
            write_csv(rank_models(results), f"{output}/baseline_results")
            write_csv(ranking, f"{output}/final_ranking")
        if trials is not None:
            write_table(trials, f"{output}/trials")
        write_model_card(
            model_card(spark, name, {f"test_{m}": v for m, v in metrics.items()}, params, table, DOMAIN_FEATURES if table.domain_features else ()),
            f"{output}/model_card",
        )
        final.release()
    return trained
