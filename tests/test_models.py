import itertools
import json
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabwright.operators import explain
from tabwright.operators.evaluate import SEARCH_SPACES, cross_validate, make_part, prepare_folds, trial_params, tune_models
from tabwright.operators.linear import one_feature_cv
from tabwright.operators.metrics import model_report, predictions_report, regression_metrics
from tabwright.operators.moments import cross_validate_moments, second_moments
from tabwright.operators.models import BASE_MODELS, base_models, build, label_stats, n_features
from tabwright.operators.projection import keep_successful
from tabwright.operators.ranking import best_model, final_ranking, rank_models, top_models
from tabwright.operators.scoring import batch_response, score, score_explain
from tabwright.operators.split import add_folds
from tabwright.plans.batch_scoring import score_csv, score_frame, score_histogram, score_json, write_json_responses
from tabwright.plans.training import load_model, train_model
from tabwright.sources.sinks import write_csv
from tabwright.streaming.score_stream import read_request_stream, score_stream, write_scores


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) * [1, 5, 0.5, 3] + 2
    y = x @ [2.5, 0.3, 4.0, 0.0] + rng.normal(size=400) + 50
    rows = [(i, float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["Id", "label", "features"]).cache()


def coordinate_descent(x, y, alpha, l1_ratio):
    x, y, n, w = x - x.mean(0), y - y.mean(), len(y), np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            rho = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (x[:, j] @ x[:, j] / n + alpha * (1 - l1_ratio))
    return w


@pytest.mark.parametrize("kind,params,l1", [("lasso", {"alpha": 0.5}, 1.0), ("elastic_net", {"alpha": 0.3, "l1_ratio": 0.4}, 0.4)])
def test_penalised_models_match_coordinate_descent(points, kind, params, l1):
    x, y, df = points
    model = build(kind, params, label_stats(df), 4).fit(df)
    assert model.coefficients.toArray() == pytest.approx(coordinate_descent(x, y, params["alpha"], l1), abs=1e-6)


def test_ridge_matches_the_closed_form(points):
    x, y, df = points
    xc, yc = x - x.mean(0), y - y.mean()
    model = build("ridge", {"alpha": 10.0}, label_stats(df), n_features(df)).fit(df)
    assert model.coefficients.toArray() == pytest.approx(np.linalg.solve(xc.T @ xc + 10 * np.eye(4), xc.T @ yc), abs=1e-8)


def test_metrics_and_report(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (0.0, -1.0)], "label double, prediction double")
    m = regression_metrics(df).first()
    assert (m["mse"], m["mae"]) == pytest.approx((2 / 3, 2 / 3)) and m["r2"] == pytest.approx(1 - 2 / (14 / 3))
    r = model_report(df, "m").first()
    assert (r["predictions_count"], r["underprediction_count"], r["overprediction_count"]) == (3, 1, 1)
    assert r["residuals"]["std_residual"] == pytest.approx(np.std([-1, 0, 1])) and r["residuals"]["q25_residual"] == -0.5
    assert [x["Percent_Error"] for x in predictions_report(df).collect()] == [100.0, 0.0, None]
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert regression_metrics(constant).first()["r2"] == 1.0


def test_ranking_breaks_ties_by_name(spark):
    rows = [("b", 1.0, "ok"), ("a", 1.0, "ok"), ("c", 0.5, "fail"), ("d", 2.0, "ok")]
    df = spark.createDataFrame(rows, "model string, cv_rmse double, status string")
    assert [r["model"] for r in rank_models(df).collect()] == ["a", "b", "d"]
    assert top_models(df, 2) == ["a", "b"] and best_model(df) == "a"
    base = df.select("model", F.col("cv_rmse").alias("test_rmse"), F.lit(0.5).alias("test_r2"))
    assert [r["model"] for r in final_ranking(base, "a", 0.1, 0.9).collect()][0] == "a (Tuned)"


def test_search_is_seeded_and_within_bounds():
    assert set(SEARCH_SPACES) == set(BASE_MODELS)
    for name in SEARCH_SPACES:
        trials = trial_params(name, 20, 42)
        assert trials == trial_params(name, 20, 42) and trials != trial_params(name, 20, 43)
        for t in trials:
            json.dumps(t)
            for key, (kind, *spec) in SEARCH_SPACES[name].items():
                if kind == "choice":
                    assert t[key] in spec[0]
                else:
                    assert spec[0] * (1 - 1e-9) <= t[key] <= spec[1] * (1 + 1e-9)
                if kind == "int":
                    assert (t[key] - spec[0]) % spec[2] == 0
    with pytest.raises(ValueError):
        trial_params("SVR", 1, 1)


def test_one_feature_cv_equals_the_loop(spark, points):
    x, y, _ = points
    df = spark.createDataFrame([(i, float(b), float(a[0]), float(a[1])) for i, (a, b) in enumerate(zip(x, y))], "Id long, label double, x0 double, x1 double")
    df = add_folds(df, "Id", 4)
    scores = one_feature_cv(df, ["x0", "x1"], "label").groupBy("model").agg(F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"))
    got = {r["model"]: (r["rmse"], r["r2"]) for r in scores.collect()}
    for c in ("x0", "x1"):
        assembler = VectorAssembler(inputCols=[c], outputCol="features")
        cv = cross_validate("linear", {}, prepare_folds(df, lambda t: assembler.transform, "Id", 4))
        assert got[c] == pytest.approx((cv["cv_rmse"], cv["cv_r2"]), rel=1e-6)


def test_tuning_skips_models_without_a_space(points):
    _, _, df = points
    folds = prepare_folds(add_folds(df, "Id", 3), lambda t: lambda rows: rows, "Id", 3)
    tuned, trials = tune_models(["Ridge", "SVR"], folds, n_trials=3, parallelism=2)
    rows = trials.collect()
    assert [r["status"] for r in rows if r["model"] == "SVR"] == ["skipped"]
    best = min((r["cv_rmse"] for r in rows if r["model"] == "Ridge"))
    assert tuned["Ridge"]["best_cv_rmse"] == best and set(tuned) == {"Ridge"}


SEARCHED = [("linear", {}), ("ridge", {"alpha": 3.0}), ("ridge", {"alpha": 250.0}), ("lasso", {"alpha": 0.4}), ("elastic_net", {"alpha": 0.2, "l1_ratio": 0.3})]


def test_moments_give_the_scores_of_fitted_models(points):
    _, _, df = points
    folds = prepare_folds(add_folds(df.withColumn("label", F.col("label") + 1e3), "Id", 3), lambda t: lambda rows: rows, "Id", 3)
    shared = [second_moments(p.kept, "_train") for p in folds]
    for kind, params in SEARCHED:
        want = cross_validate(kind, params, folds)
        got = cross_validate_moments(kind, params, shared)
        assert (got["cv_rmse"], got["cv_r2"]) == pytest.approx((want["cv_rmse"], want["cv_r2"]), rel=1e-6), kind


def test_a_search_of_linear_models_reads_each_fold_once(spark, points):
    _, _, df = points
    folds = prepare_folds(add_folds(df, "Id", 2), lambda t: lambda rows: rows, "Id", 2)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("search", "search")
    try:
        tune_models(["Ridge", "Lasso", "ENet"], folds, n_trials=15)
        jobs = len(tracker.getJobIdsForGroup("search"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12  # two folds: means and products, with their shuffles; 90 fits before


# --- explanations ---------------------------------------------------------------------


def brute_force(nodes, x):
    """Shapley values by enumerating all subsets of known features."""
    rows = {(n["tree"], n["id"]): n for n in nodes}

    def expected(tree, node, known):
        n = rows[tree, node]
        if n["left"] < 0:
            return n["prediction"]
        left, right = rows[tree, n["left"]], rows[tree, n["right"]]
        if n["feature"] in known:
            return expected(tree, n["left"] if x[n["feature"]] <= n["split"][0] else n["right"], known)
        return (left["cover"] * expected(tree, n["left"], known) + right["cover"] * expected(tree, n["right"], known)) / n["cover"]

    roots = [(n["tree"], n["weight"]) for n in nodes if n["id"] == 0]
    value = lambda known: sum(w * expected(t, 0, known) for t, w in roots)
    d, phi = len(x), []
    for j in range(d):
        rest, total = [k for k in range(d) if k != j], 0.0
        for size in range(d):
            weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
            total += sum(weight * (value({*s, j}) - value(set(s))) for s in itertools.combinations(rest, size))
        phi.append(total)
    return phi, value(set())


@pytest.mark.parametrize(
    "kind,params",
    [("forest", {"n_estimators": 4, "max_depth": 5, "max_features": None}), ("boosting", {"n_estimators": 4, "learning_rate": 0.3, "max_depth": 4})],
)
def test_tree_contributions_equal_brute_force(points, kind, params):
    x, _, df = points
    model = build(kind, params, label_stats(df), 4).fit(df)
    nodes = explain.node_table(model)
    leaves = explain.leaf_table(nodes)
    rows = explain.tree_shap(model.transform(df), leaves).orderBy("Id").collect()
    base, collected = explain.base_value(leaves), nodes.collect()
    for r in rows:
        assert base + sum(r["shap"]) == pytest.approx(r["prediction"], abs=1e-9)
    blocks = leaves.transform(lambda d: explain.in_blocks(d.withColumn("id", F.monotonically_increasing_id()), 700))
    assert blocks.select("block").distinct().count() > 2
    by_block = explain.tree_shap(df, blocks).select("Id", F.col("shap").alias("again")).collect()
    assert all(dict(by_block)[r["Id"]] == pytest.approx(r["shap"], abs=1e-9) for r in rows)
    for r in rows[:12]:
        phi, expected_base = brute_force(collected, x[r["Id"]])
        assert r["shap"] == pytest.approx(phi, abs=1e-9) and base == pytest.approx(expected_base)


def test_top_contributions_and_waterfall(spark):
    df = spark.createDataFrame(
        [(1, 9.0, [1.0, -3.0, 1.0, 0.0], Vectors.dense([9.0, 8.0, 7.0, 6.0]))], ["Id", "prediction", "shap", "features"]
    )
    slots = [{"name": f"n{i}", "source_column": f"s{i}"} for i in range(4)]
    originals = F.create_map(F.lit("s1"), F.lit("raw"))
    top = explain.explain_topk(df, slots, 2, originals=originals)
    rows = explain.explode_explanations(top, "Id").collect()
    assert [(r["rank"], r["feature_name"], r["original_value"], r["contribution_type"]) for r in rows] == [
        (1, "n1", "raw", "negative"), (2, "n0", "9.0", "positive"),
    ]
    steps = explain.waterfall(top, "Id", 10.0).orderBy("step").collect()
    assert [(s["feature"], s["amount"], s["running_total"]) for s in steps] == [
        ("Base Value", 10.0, 10.0), ("n1", -3.0, 7.0), ("n0", 1.0, 8.0), ("Other features", 1.0, 9.0), ("Predicted Price", -1.0, 9.0),
    ]


# --- the whole job ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def trained(spark, sales, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("job") / "out")
    models = base_models({"XGB": {"n_estimators": 6, "learning_rate": 0.3}}, names=["Ridge", "XGB"])
    models["Broken"] = ("unknown", {})
    job = train_model(sales, models=models, k=2, n_trials=2, top_models_to_tune=1, parallelism=2, exact_test_size=True, output=path)
    return job, path, load_model(spark, path)


def test_training_results(spark, trained):
    job, path, _ = trained
    results = {r["model"]: r for r in job.results.collect()}
    assert results["Broken"]["status"] == "fail" and "unknown" in results["Broken"]["error"]
    assert results["Ridge"]["cv_r2"] > 0.9 and job.name == "Ridge" and job.metrics["r2"] > 0.9
    assert job.report.count() == 120 and job.trials.count() == 2
    assert [r["model"] for r in job.ranking.collect()].count("Ridge (Tuned)") == 1
    assert spark.read.option("header", True).csv(f"{path}/final_ranking").columns == ["model", "test_rmse", "test_r2"]


def test_saved_model_scores_like_the_fitted_one(sales, trained):
    job, _, saved = trained
    records = sales.drop("SalePrice")
    fitted = {r["Id"]: r["prediction"] for r in job.pipeline.transform(records).select("Id", "prediction").collect()}
    loaded = score(records, saved.pipeline, saved.expected, saved.name, ["Id"]).collect()
    assert len(loaded) == 600 and all(r["predicted_price"] == pytest.approx(fitted[r["Id"]]) for r in loaded)


def test_explained_scores_add_up(sales, trained):
    _, _, saved = trained
    rows = score_explain(sales.drop("SalePrice").limit(20), saved.pipeline, saved.explainer, saved.expected, saved.name, 500, ["Id"]).collect()
    for r in rows:
        assert r["base_value"] + sum(e["shap_value"] for e in r["explanations"]) == pytest.approx(r["predicted_price"], rel=1e-9)
    qualities = {r["Id"]: r["OverallQual"] for r in sales.select("Id", "OverallQual").collect()}
    shown = {r["Id"]: e["original_value"] for r in rows for e in r["explanations"] if e["feature_name"] == "OverallQual"}
    assert all(shown[i] == str(qualities[i]) for i in shown)


def test_bad_rows_do_not_stop_a_batch(spark, trained):
    _, _, saved = trained
    records = spark.createDataFrame([(0, "8450", "7"), (1, "-5", "7"), (2, "wide", "7")], "position int, LotArea string, OverallQual string")
    batch = score_frame(records, saved, keep=["position"])
    rows = {r["position"]: r for r in batch.scored.collect()}
    assert rows[0]["error"] is None and rows[0]["confidence"] == 0.85 and rows[0]["predicted_price"] is not None
    assert rows[1]["error"] == "LotArea must not be negative" and rows[1]["predicted_price"] is None and rows[1]["confidence"] == 0.0
    assert rows[2]["error"] == "LotArea is not int"
    assert keep_successful(batch.scored).count() == 1 and batch.summary.first()["n"] == 1
    response = batch_response(batch.scored.withColumn("body", F.lit(1)), "position", ["body"]).first()
    assert response["total_processed"] == 3 and len(response["predictions"]) == 1
    with pytest.raises(ValueError):
        score_frame(records, saved, max_rows=2)
    assert score_histogram(batch.scored).agg(F.sum("n")).first()[0] == 1


def test_csv_and_json_jobs(spark, trained, tmp_path):
    _, _, saved = trained
    (tmp_path / "in.csv").write_text("Ref,LotArea,OverallQual,1stFlrSF,Bedrooms\nr1,8450,7,856,3\nr2,wide,8,NA,4\nr3,9600,8,NA,4\n")
    score_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), saved, keep=["Ref"])
    out = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("No").collect()
    assert list(out[0].asDict()) == ["No", "Ref", "Predicted Price", "Confidence", "Model", "Error"]
    assert [(r["No"], r["Ref"], bool(r["Predicted Price"]), r["Error"]) for r in out] == [
        ("1", "r1", True, None), ("2", "r2", False, "LotArea is not int"), ("3", "r3", True, None)
    ]
    (tmp_path / "b.json").write_text(json.dumps({"houses": [{"LotArea": 8450, "FirstFlrSF": 856}, {"LotArea": "?"}]}))
    rows = score_json(spark, str(tmp_path / "b.json"), saved, explain=True, top_k=3).orderBy("position").collect()
    write_json_responses(score_json(spark, str(tmp_path / "b.json"), saved), str(tmp_path / "responses"))
    answers = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "responses")).collect()]
    assert [(len(a["predictions"]), a["total_processed"]) for a in answers] == [(1, 2)]
    assert len(rows[0]["explanations"]) == 3 and rows[1]["explanations"] is None and rows[1]["error"] == "LotArea is not int"


def test_stream_equals_batch(spark, sales, trained, tmp_path):
    _, _, saved = trained
    records = sales.drop("SalePrice")
    records.repartition(4).write.json(str(tmp_path / "requests"))
    stream = read_request_stream(spark, str(tmp_path / "requests"), schema=records.schema, max_files=2)
    scored = score_stream(stream, saved.pipeline, saved.expected, saved.name, ["Id"])
    write_scores(scored, str(tmp_path / "scores"), str(tmp_path / "progress")).awaitTermination()
    got = {r["Id"]: r["predicted_price"] for r in spark.read.parquet(str(tmp_path / "scores")).collect()}
    want = {r["Id"]: r["predicted_price"] for r in score(records, saved.pipeline, saved.expected, saved.name, ["Id"]).collect()}
    assert got == pytest.approx(want) and len(got) == 600


def test_body_stream_survives_a_stop_between_its_two_sinks(spark, trained, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from tabwright.streaming.score_stream import read_body_stream, score_bodies, write_bodies

    _, _, saved = trained
    house = {"LotArea": 8450, "OverallQual": 7, "FirstFlrSF": 856}
    good = [(f"g{i}", json.dumps({"houses": [house, {"LotArea": "wide"}, {**house, "LotArea": 9000 + i}]})) for i in range(5)]
    bad = [("b1", "{"), ("b2", json.dumps({"other": 1})), ("b3", json.dumps({"houses": []})), ("b4", None), ("b5", json.dumps({"houses": 7}))]
    for part in (good[:2] + bad[:2], good[2:] + bad[2:]):
        spark.createDataFrame(part, "request_id string, body string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    results, rejects = str(tmp_path / "results"), str(tmp_path / "rejects")

    def start():
        bodies = read_body_stream(spark, str(tmp_path / "in"), max_files=1)
        one = lambda batch: score_bodies(batch, saved.pipeline, saved.expected, saved.name, explainer=saved.explainer, top_k=2)
        write_bodies(bodies, one, results, rejects).awaitTermination()

    plain, stopped = DataFrameWriter.parquet, []

    def stop_once(writer, path, *args, **kwargs):
        if path.endswith("rejects/batch=1") and not stopped:
            stopped.append(path)
            raise RuntimeError("stopped between the sinks")
        return plain(writer, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", stop_once)
    with pytest.raises(Exception, match="stopped between the sinks"):
        start()
    assert stopped and spark.read.parquet(results).select("batch").distinct().count() == 2
    start()
    start()  # nothing is new
    rows = spark.read.parquet(results).orderBy("request_id", "position").collect()
    assert [(r["request_id"], r["position"]) for r in rows] == [(f"g{i}", p) for i in range(5) for p in (0, 2)]
    assert all(r["predicted_price"] > 0 and len(r["explanations"]) == 2 for r in rows)
    wrong = {(r["request_id"], r["position"]): r["error"] for r in spark.read.parquet(rejects).collect()}
    assert spark.read.parquet(rejects).count() == len(wrong) == 10
    assert all(wrong[f"g{i}", 1] == "LotArea is not int" for i in range(5))
    none = "the body has no list of houses"
    assert {k: wrong[k, None] for k, _ in bad} == {"b1": none, "b2": none, "b3": "the list of houses is empty", "b4": none, "b5": none}


def test_parts_kept_as_a_table_give_the_same_scores(points):
    _, _, df = points
    data = df.withColumn("split", F.when(F.col("Id") % 5 == 0, "test").otherwise("train"))
    scores = []
    for storage in ("memory", "table"):
        part = make_part(data, F.col("split") == "train", lambda rows: rows, ["Id"], storage=storage)
        scores.append(cross_validate("ridge", {"alpha": 1.0}, [part])["cv_rmse"])
    assert scores[0] == pytest.approx(scores[1])


def test_write_csv_has_headers(spark, tmp_path):
    write_csv(spark.range(2), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).columns == ["id"]


def test_both_solvers_give_the_same_ridge(spark):
    from tabwright.operators.models import LabelStats, build

    rows = spark.range(400).select((F.rand(1) * 5).alias("a"), (F.rand(2) * 5).alias("b"), F.randn(3).alias("e"))
    rows = rows.withColumn("label", 3 * F.col("a") - F.col("b") + F.col("e")).cache()
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    stats = LabelStats(400, rows.agg(F.stddev_pop("label")).first()[0])
    normal, other = (build("ridge", {"alpha": 30.0, "solver": s}, stats, 2).fit(data) for s in ("normal", "l-bfgs"))
    assert list(other.coefficients) == pytest.approx(list(normal.coefficients), rel=1e-6)


def test_trees_deeper_than_possible_are_refused():
    from tabwright.operators.models import LabelStats, build

    with pytest.raises(ValueError):
        build("forest", {"n_estimators": 2, "max_depth": 31}, LabelStats(10, 1.0), 2)


def test_long_level_tables_score_rows_with_maps_and_missing_keys(spark, monkeypatch):
    from tabwright.operators import lookup
    from tabwright.operators.encoders import TargetEncoder

    train = spark.range(900).select((F.col("id") % 300).cast("string").alias("c"), F.rand(1).alias("label"))
    new = spark.range(600).select(F.when(F.col("id") % 3 == 0, (F.col("id") % 400).cast("string")).alias("c"), F.create_map(F.lit("k"), F.lit("v")).alias("m"), "id")
    want = {}
    for bound in (lookup.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", bound)
        model = TargetEncoder(cols=["c"]).fit(train)
        want[bound] = {r["id"]: r["TE_c"] for r in model.transform(new).collect()}
    first, second = want.values()
    assert first == second and len(first) == 600
