import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabwright.operators.evaluate import cross_validate, cross_validate_counts, fit_part, make_part, tune_models
from tabwright.operators.metrics import regression_metrics
from tabwright.operators.prefixes import prefix_scores


@pytest.fixture(scope="module")
def part(spark):
    rows = spark.range(500).select("id", (F.rand(1) * 9).alias("a"), (F.rand(2) * 5).alias("b"), F.randn(3).alias("e"))
    rows = rows.withColumn("label", F.col("a") * F.col("b") + F.sin("a") * 5 + F.col("e")).repartition(4).cache()
    assembler = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    return make_part(rows, F.col("id") % 4 != 0, assembler.transform, ["id"])


@pytest.mark.parametrize("block_bytes", [32 << 20, 100, 1])
def test_prefixes_equal_ensembles_of_that_size(part, block_bytes):
    params = {"learning_rate": 0.4, "max_depth": 3, "subsample": 0.7}
    model = fit_part("boosting", {**params, "n_estimators": 5}, part)
    found = {r["n_estimators"]: r for r in prefix_scores(model, part.valid, block_bytes=block_bytes).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5] and model.getLeafCol() == ""
    for n in (1, 3, 5) if block_bytes > 100 else (5,):
        small = model if n == 5 else fit_part("boosting", {**params, "n_estimators": n}, part)
        want = regression_metrics(small.transform(part.valid)).first()
        for m in ("rmse", "mae", "r2"):
            assert found[n][m] == pytest.approx(want[m], rel=1e-9)
    assert found[5]["rmse"] < found[1]["rmse"]


def test_prefixes_of_a_forest_are_means_of_its_first_trees(part):
    model = fit_part("forest", {"n_estimators": 3, "max_depth": 4, "max_features": None}, part)
    found = {r["n_estimators"]: r["rmse"] for r in prefix_scores(model, part.valid).collect()}
    assert found[3] == pytest.approx(regression_metrics(model.transform(part.valid)).first()["rmse"], rel=1e-9)
    scored, means = part.valid.select("label", "features"), []
    for i in (0, 1):
        scored = model.trees[i].setPredictionCol(f"p{i}").transform(scored)
        means.append(f"p{i}")
        off = F.col("label") - sum(F.col(m) for m in means) / len(means)
        assert found[i + 1] == pytest.approx(scored.agg(F.sqrt(F.avg(off * off))).first()[0], rel=1e-9)


def test_rows_without_a_label_and_empty_tables(part):
    model = fit_part("boosting", {"n_estimators": 2, "learning_rate": 0.4, "max_depth": 2}, part)
    some = part.valid.withColumn("label", F.when(F.col("id") % 8 == 0, F.col("label")))
    want = regression_metrics(model.transform(some.filter("label IS NOT NULL"))).first()["rmse"]
    assert {r["n_estimators"]: r["rmse"] for r in prefix_scores(model, some).collect()}[2] == pytest.approx(want)
    assert prefix_scores(model, part.valid.filter("id < 0")).count() == 0


def test_a_search_fits_once_for_all_tree_counts(part, monkeypatch):
    from tabwright.operators import evaluate

    fits, plain = [], evaluate.fit_part
    monkeypatch.setattr(evaluate, "fit_part", lambda kind, params, *rest: fits.append(params["n_estimators"]) or plain(kind, params, *rest))
    params = {"learning_rate": 0.5, "max_depth": 2}
    counts = cross_validate_counts("boosting", params, [2, 4], [part])
    assert fits == [4] and sorted(counts) == [2, 4]
    assert counts[2]["cv_rmse"] == pytest.approx(cross_validate("boosting", {**params, "n_estimators": 2}, [part])["cv_rmse"], rel=1e-9)
    fits.clear()
    spaces = {"Boost": {"n_estimators": ("int", 2, 6, 2), "learning_rate": ("float", 0.3, 0.6)}}
    tuned, trials = tune_models(["Boost"], [part], 2, models={"Boost": ("boosting", {"max_depth": 2})}, spaces=spaces, every_tree_count=True)
    assert fits == [6, 6] and tuned["Boost"]["best_params"]["n_estimators"] in (2, 4, 6)
    assert trials.filter("status = 'ok'").count() == 2
