import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.config import TableConfig
from tabwright.operators import lookup, profile, quantiles
from tabwright.operators.assembly import FeatureRouter, feature_name_table
from tabwright.operators.encoders import MissingFlags, OneHotLevels, OneHotLevelsModel, OrdinalMapper, RarePooler, TargetEncoder
from tabwright.operators.imputers import MedianImputer, ModeImputer, RuleImputer, Sanitizer
from tabwright.operators.projection import separate_target
from tabwright.operators.ranks import row_index
from tabwright.operators.scaling import PopulationScaler, QuantileNormal
from tabwright.plans.feature_space import expected_columns, feature_names, fit_feature_space


@pytest.fixture(scope="module")
def levels(spark):
    rows = [("a",)] * 16 + [("b",)] * 15 + [("c",)] * 14 + [(None,)] * 15
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, c string")


def test_rare_levels_at_the_threshold(spark, levels):
    model = RarePooler(cols=["c"], minCount=15).fit(levels)
    counts = {r["c"]: r["count"] for r in model.transform(levels).groupBy("c").count().collect()}
    assert counts == {"a": 16, "b": 15, "nan": 15, "Other": 14}
    assert model.transform(spark.createDataFrame([(1, "new")], "id int, c string")).first()["c"] == "Other"
    by_share = RarePooler(cols=["c"], minShare=0.26).fit(levels).transform(levels)
    assert {r["c"] for r in by_share.select("c").distinct().collect()} == {"a", "Other"}


def test_target_means_are_smoothed(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 11.0), (None, 5.0)], "k string, label double")
    new = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("z", 0.0), (None, 0.0)], "k string, label double")
    for alpha in (0.0, 10.0, 30.0):
        got = [r["TE_k"] for r in TargetEncoder(cols=["k"], alpha=alpha).fit(df).transform(new).collect()]
        want = [(2 * 2 + alpha * 5) / (2 + alpha), (11 + alpha * 5) / (1 + alpha), 5.0, 5.0]
        assert got == pytest.approx(want)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_long_level_tables_give_the_same_result(spark, monkeypatch, broadcast_bytes):
    """Broadcast join and salted shuffle join against the literal lookup; one
    level holds a third of the rows and another third has no level."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), (F.col("id") % 41).cast("string")))
    df = spark.range(3000).select("id", key.alias("k"), (F.col("id") % 17).cast("double").alias("label"))
    stages = Pipeline(stages=[TargetEncoder(cols=["k"], alpha=5.0), RarePooler(cols=["k"], minCount=25)])
    want = sorted(tuple(r) for r in stages.fit(df).transform(df).select("id", "k", F.round("TE_k", 9)).collect())
    monkeypatch.setattr(lookup, "LITERAL_LEVELS", 3)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", broadcast_bytes)
    out = stages.fit(df).transform(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    assert sorted(tuple(r) for r in out.select("id", "k", F.round("TE_k", 9)).collect()) == want


def test_ordinals_and_flags(spark):
    df = spark.createDataFrame([("Po", 1), ("Ex", None), ("??", 2), (None, 3)], "ExterQual string, n int")
    mapped = OrdinalMapper().transform(df)
    assert [r[0] for r in mapped.select("ExterQual").collect()] == [0.0, 4.0, None, None]
    flagged = MissingFlags().fit(mapped).transform(mapped)
    assert [(r["ExterQual_was_missing"], r["n_was_missing"]) for r in flagged.collect()] == [(0, 0), (0, 1), (1, 0), (1, 0)]
    assert MissingFlags(autoNumeric=False).fit(df).transform(df).columns == df.columns


def test_imputers(spark):
    df = spark.createDataFrame(
        [(1.0, "b", None, 9), (2.0, "a", None, 10), (3.0, None, "x", 10), (10.0, "b", None, 9), (None, "a", "x", None)],
        "m double, s string, e string, i int",
    )
    filled = Pipeline(stages=[MedianImputer(cols=["m", "i"]), ModeImputer(cols=["s"])]).fit(df).transform(df).collect()
    assert filled[4]["m"] == 2.5 and filled[4]["i"] == 9.5 and filled[2]["s"] == "a"
    assert ModeImputer(cols=["i"]).fit(df).value("fills") == {"i": 9}
    rules = RuleImputer(rules={"e": ("constant", "None"), "absent": ("mode", None)}).fit(df)
    assert [r["e"] for r in rules.transform(df).collect()] == ["None", "None", "x", "None", "x"]


def test_one_hot_ignores_unknown_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",)], "c string")
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    model = OneHotLevels(cols=["c"]).fit(train)
    assert model.value("labels") == [["a", "b"]] and model.value("frequent") == [["a", "b"]]
    got = [list(r[0]) for r in model.transform(new).select(vector_to_array("c_ohe")).collect()]
    assert got == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_one_hot_table_equals_the_literals(spark, monkeypatch, tmp_path):
    import tabwright.operators.encoders as encoders
    import tabwright.operators.lookup as lookup

    train = spark.range(30).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    new = train.unionByName(spark.createDataFrame([("nan", "0"), (None, None), ("k100", "1")], "c string, d string"))
    vectors = lambda model: sorted((r["c"] or "", r["d"] or "", *r["x"], *r["y"]) for r in model.transform(new).select("c", "d", vector_to_array("c_ohe").alias("x"), vector_to_array("d_ohe").alias("y")).collect())
    want = vectors(OneHotLevels(cols=["c", "d"]).fit(train))
    for module in (encoders, lookup):
        monkeypatch.setattr(module, "LITERAL_LEVELS", 5)
    model = OneHotLevels(cols=["c", "d"]).fit(train)
    assert model.value("labels") == [None, ["0", "1", "2"]] and model.value("sizes") == [30, 3] and vectors(model) == want
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    assert vectors(model) == want
    model.write().overwrite().save(str(tmp_path / "m"))
    assert vectors(OneHotLevelsModel.load(str(tmp_path / "m"))) == want


def test_one_hot_of_any_width(spark):
    """More levels than a fit may hold on the driver: every level has its slot, and the sum over the rows is one for each."""
    n = 200_000
    train = spark.range(n).select(F.format_string("level%07d", (F.col("id") * 7919) % n).alias("c"), F.col("id"))
    model = OneHotLevels(cols=["c"]).fit(train)
    assert model.value("labels") == [None] and model.value("sizes") == [n]
    text = F.col("c_ohe").cast("string")
    slots = model.transform(train).select("c", F.regexp_extract(text, r"^\((\d+),\[(\d*)\]", 1).cast("int").alias("size"), F.regexp_extract(text, r"\[(\d*)\]", 1).cast("int").alias("slot"))
    row = slots.agg(F.min("size"), F.max("size"), F.count_distinct("slot"), F.count_if(F.col("slot") != F.substring("c", 6, 7).cast("int"))).first()
    assert tuple(row) == (n, n, n, 0)
    names = feature_name_table(spark, FeatureRouter(oneHot=[["c", "c_ohe", None, n]], scalars=[["x", "x", "numeric_complete"]]), model.levels)
    assert names.count() == n + 1 and names.filter("idx = 5").first()["name"] == "c_level0000005" and names.filter(f"idx = {n}").first()["name"] == "x"


def test_row_index_is_dense_and_in_order(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), F.lit("hot").alias("h"))
    rows = row_index(df, ["h", F.col("k").desc()], "place").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(5000)) and [r["k"] for r in rows] == sorted((r["k"] for r in rows), reverse=True)
    assert row_index(df.limit(0), ["k"]).collect() == []


def test_quantile_normal_is_monotone_and_bounded(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    model = QuantileNormal(cols=["x"]).fit(df)
    z = [r[0] for r in model.transform(df).collect()]
    assert all(a <= b for a, b in zip(z, z[1:]))
    assert z[0] == pytest.approx(-5.1993375826) and z[-1] == pytest.approx(-z[0])
    out = [r[0] for r in model.transform(spark.createDataFrame([(-5.0,), (1e12,), (None,)], "x double")).collect()]
    assert out[0] == z[0] and out[1] == z[-1] and out[2] is None


def test_population_scaler_and_sanitizer(spark):
    df = spark.createDataFrame([(1.0, 7.0, None), (3.0, 7.0, None)], "a double, b double, e double")
    out = PopulationScaler(cols=["a", "b"]).fit(df).transform(df).collect()
    assert [(r["a"], r["b"]) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]
    clean = Sanitizer().fit(df).transform(spark.createDataFrame([(float("inf"), 1.0, 1.0)], "a double, b double, e double"))
    assert clean.columns == ["a", "b"] and clean.first()["a"] is None


@pytest.mark.parametrize("ranges", ["1", "8", "50"])
def test_quantiles_over_any_number_of_ranges(spark, ranges):
    df = spark.range(6000).select(
        F.when(F.rand(1) < 0.34, 5.0).otherwise(F.rand(2) * 10).alias("hot"),
        F.when(F.rand(3) > 0.1, F.floor(F.rand(4) * 7).cast("double")).alias("ties"),
        F.randn(5).alias("smooth"),
        F.lit(3.0).alias("constant"),
    ).cache()
    probs = [0.0, 0.25, 0.5, 0.66, 0.99, 1.0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = quantiles.exact_quantiles(df, {c: probs for c in df.columns})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    empty = quantiles.exact_quantiles(spark.createDataFrame([(None,), (float("nan"),)], "x double"), {"x": [0.5]})
    assert empty == {"x": [None]}
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1.7e308, -1.7e308, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, 2.0, 2.0 - 2**-52, -1.0, 3.0]
    row = spark.createDataFrame([(x,) for x in odd * 3], "x double")
    grid = [i / (3 * len(odd) - 1) for i in range(3 * len(odd))]
    few = quantiles.FEW_VALUES
    for quantiles.FEW_VALUES in (few, 0):
        assert quantiles.exact_quantiles(row, {"x": grid})["x"] == pytest.approx(sorted(odd * 3), abs=0, rel=1e-12)
    quantiles.FEW_VALUES = few
    ends = spark.createDataFrame([(x,) for x in (float("inf"), -float("inf"), 1.0)], "x double")
    assert quantiles.exact_quantiles(ends, {"x": [0.0, 0.5, 1.0]})["x"] == [-float("inf"), 1.0, float("inf")]
    pdf = df.toPandas()
    for c in df.columns:
        assert got[c] == pytest.approx(list(np.quantile(pdf[c].dropna(), probs)), abs=1e-12)


def test_profiles(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, float("nan"), None), (3, 5.0, "b")], "i int, d double, s string")
    got = [(r["column"], r["missing"], round(r["missing_pct"], 2)) for r in profile.missing_profile(df).collect()]
    assert got == [("d", 2, 66.67), ("s", 1, 33.33)]
    assert profile.missing_totals(df.limit(0)).first()["missing_pct"] is None
    assert profile.histogram(df.filter("i = 1"), "i", 4).agg(F.sum("n")).first()[0] == 1
    assert profile.kernel_density(df.filter("i = 1"), "i").count() == 0


def test_correlation_skips_gaps_and_constants(spark):
    df = spark.range(200).select(
        F.when(F.rand(1) > 0.2, F.randn(2) * 3 + 1000).alias("a"), F.when(F.rand(3) > 0.1, F.randn(4)).otherwise(float("nan")).alias("b"), F.lit(0.1).alias("c")
    ).cache()
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df).collect()}
    pdf = df.toPandas().astype(float)
    assert got["a", "b"] == got["b", "a"] == pytest.approx(pdf["a"].corr(pdf["b"]))
    assert got["a", "a"] == 1.0 and got["a", "c"] is None and got["c", "c"] is None and len(got) == 9
    assert [r["column"] for r in profile.top_correlated(df, "a").collect()] == ["a", "b", "c"]
    assert profile.correlation_matrix(df.limit(0)).filter("corr IS NOT NULL").count() == 0


def test_feature_space_round_trip(spark, sales, tmp_path):
    df = separate_target(sales, "SalePrice")
    model = fit_feature_space(df, TableConfig())
    names = feature_names(model).collect()
    width = model.transform(df).select("features").first()[0].size
    assert len(names) == width and [r["idx"] for r in names] == list(range(width))
    kinds = {r["kind"] for r in names}
    assert kinds == {"one_hot", "ordinal", "numeric_complete", "numeric_missing", "target_mean", "missing_flag"}
    assert {r["source_column"] for r in names if r["kind"] == "missing_flag"} == {"LotFrontage", "GarageYrBlt", "MasVnrArea"}
    assert "Id" not in {r["source_column"] for r in names} and "label" not in {r["source_column"] for r in names}
    assert expected_columns(model)["Neighborhood"] == "string"
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    v = vector_to_array("features")
    first = {r["Id"]: r["v"] for r in model.transform(df).select("Id", v.alias("v")).collect()}
    second = {r["Id"]: r["v"] for r in again.transform(df.repartition(5)).select("Id", v.alias("v")).collect()}
    assert first == second
    assert not np.isnan(np.array(list(first.values()))).any()


def test_one_hot_slots_equal_a_separate_fit(spark, sales):
    df = separate_target(sales, "SalePrice")
    model = fit_feature_space(df, TableConfig())
    pooler = next(s for s in model.stages if type(s).__name__ == "RarePoolerModel")
    one_hot = next(s for s in model.stages if type(s).__name__ == "OneHotLevelsModel")
    before = PipelineModel(model.stages[: model.stages.index(pooler) + 1]).transform(df)
    assert OneHotLevels(cols=one_hot.value("cols")).fit(before).value("labels") == one_hot.value("labels")
