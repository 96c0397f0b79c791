"""Queries on fitted stages, models, explanations and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.config import SEED, TableConfig
from tabwright.functions.normal import CENTRAL_DEN, CENTRAL_NUM, FAR_DEN, FAR_NUM, NEAR_DEN, NEAR_NUM
from tabwright.functions.hashing import seeded_hash
from tabwright.operators import explain
from tabwright.operators.encoders import MissingFlags, OneHotLevels, OrdinalMapper, RarePooler, TargetEncoder
from tabwright.operators.evaluate import cross_validate, evaluate_models, fit_part, make_part, prepare_folds, trial_params, tune_models
from tabwright.operators.imputers import MedianImputer, ModeImputer, RuleImputer, Sanitizer
from tabwright.operators.linear import ols_by_group, one_feature_cv, ridge_two_features
from tabwright.operators.metrics import (
    mean_over_folds,
    metric_columns,
    metrics_on_both_scales,
    model_report,
    predictions_report,
    regression_metrics,
    residual_statistics,
)
from tabwright.operators.models import build, label_stats
from tabwright.operators.prefixes import prefix_scores
from tabwright.operators.ranking import final_ranking, rank_models
from tabwright.operators.scaling import PopulationScaler, QuantileNormal
from tabwright.operators.scoring import score, score_explain
from tabwright.operators.split import add_folds, hash_split
from tabwright.plans.feature_space import feature_names, fit_feature_space
from tabwright.plans.registry import query
from tabwright.plans.training import load_model, train_model
from tabwright.plans.views import (
    PARTS_SQL,
    SALES_SQL,
    fold_sql,
    folded_parts,
    hash_sql,
    kept_sales,
    parts,
    rounded,
    sales,
    split_parts,
    split_sql,
    table,
)
from tabwright.session import materialize, scratch_path
from tabwright.sources.sinks import ResultCache, RunLog, model_card
from tabwright.streaming.score_stream import read_body_stream, read_request_stream, score_bodies, score_stream, write_bodies, write_scores

# --- fixed values: order of the priorities, lowest first ---------------------------
PRIORITY_LEVELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
# --- end of fixed values -------------------------------------------------------------

SPLIT_PARTS_SQL = f"{PARTS_SQL}, sp AS (SELECT *, {split_sql('row_id')} AS split FROM parts)"


# --- encoders, imputers, scalers -------------------------------------------------------


@query(
    "value_counts_pooled",
    f"""WITH {PARTS_SQL}, counted AS (SELECT brand_type, count(*) AS n FROM parts GROUP BY 1)
    SELECT CASE WHEN n >= 15 THEN brand_type ELSE 'Other' END AS level, sum(n)::BIGINT AS n FROM counted GROUP BY 1""",
)
def value_counts_pooled(spark, sf_dir):
    p = parts(spark, sf_dir)
    pooled = RarePooler(cols=["brand_type"], minCount=15).fit(p).transform(p)
    return pooled.groupBy(F.col("brand_type").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rare_pool_by_share",
    f"""WITH {PARTS_SQL}, counted AS (SELECT coalesce("type", 'nan') AS level, count(*) AS n FROM parts GROUP BY 1),
    kept AS (SELECT level FROM counted WHERE n >= 0.18 * (SELECT count(*) FROM parts))
    SELECT row_id, CASE WHEN coalesce("type", 'nan') IN (SELECT level FROM kept) THEN coalesce("type", 'nan') ELSE 'Other' END AS "type" FROM parts""",
)
def rare_pool_by_share(spark, sf_dir):
    p = parts(spark, sf_dir).select("row_id", "type")
    return RarePooler(cols=["type"], minShare=0.18).fit(p).transform(p)


def _target_mean_sql(column: str) -> str:
    return f"""(SELECT "{column}" AS k, (count(label) * avg(label) + 30.0 * any_value(g)) / (count(label) + 30.0) AS te
        FROM sp CROSS JOIN (SELECT avg(label) AS g FROM sp WHERE split = 'train') WHERE split = 'train' AND "{column}" IS NOT NULL GROUP BY 1)"""


TARGET_ENCODE_SQL = f"""WITH {SPLIT_PARTS_SQL}
    SELECT row_id, sp.split, round(coalesce(b.te, g), 6) AS "TE_brand", round(coalesce(t.te, g), 6) AS "TE_type"
    FROM sp CROSS JOIN (SELECT avg(label) AS g FROM sp WHERE split = 'train')
    LEFT JOIN {_target_mean_sql('brand')} b ON sp.brand = b.k LEFT JOIN {_target_mean_sql('type')} t ON sp."type" = t.k"""


def _target_encoded(model, df):
    return model.transform(df).select(
        "row_id", "split", F.round("TE_brand", 6).alias("TE_brand"), F.round("TE_type", 6).alias("TE_type")
    )


@query("target_encode", TARGET_ENCODE_SQL)
def target_encode(spark, sf_dir):
    df = split_parts(spark, sf_dir)
    model = TargetEncoder(cols=["brand", "type"], alpha=30.0).fit(df.filter("split = 'train'"))
    return _target_encoded(model, df)


@query("model_roundtrip", TARGET_ENCODE_SQL)
def model_roundtrip(spark, sf_dir):
    df = split_parts(spark, sf_dir)
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=[TargetEncoder(cols=["brand", "type"], alpha=30.0)]).fit(df.filter("split = 'train'")).write().save(path)
    return _target_encoded(PipelineModel.load(path), df)


@query(
    "ordinal_map",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0.0 WHEN '4-NOT SPECIFIED' THEN 1.0 WHEN '3-MEDIUM' THEN 2.0
    WHEN '2-HIGH' THEN 3.0 WHEN '1-URGENT' THEN 4.0 END::DOUBLE AS o_orderpriority FROM orders""",
)
def ordinal_map(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return OrdinalMapper(mapping={"o_orderpriority": PRIORITY_LEVELS}).transform(orders)


@query(
    "missing_flags",
    f"""WITH {SALES_SQL} SELECT "Id", ("MoSold" IS NULL)::INTEGER AS "MoSold_was_missing",
    ("GrLivArea" IS NULL)::INTEGER AS "GrLivArea_was_missing" FROM sales""",
)
def missing_flags(spark, sf_dir):
    s = kept_sales(spark, sf_dir, ["Id", "YrSold", "MoSold", "GrLivArea"])
    flagged = MissingFlags(exclude=["Id"]).fit(s).transform(s)
    return flagged.drop("YrSold", "MoSold", "GrLivArea")


@query(
    "impute_mode_median",
    f"""WITH {PARTS_SQL}, m AS (SELECT median(size) AS med FROM parts),
    f AS (SELECT "type" AS top FROM parts WHERE "type" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT row_id, coalesce(size, med)::DOUBLE AS size, coalesce("type", top) AS "type" FROM parts CROSS JOIN m CROSS JOIN f""",
)
def impute_mode_median(spark, sf_dir):
    p = parts(spark, sf_dir).select("row_id", "size", "type")
    stages = [MedianImputer(cols=["size"]), ModeImputer(cols=["type"])]
    return Pipeline(stages=stages).fit(p).transform(p)


@query(
    "impute_rules",
    f"""WITH {SALES_SQL}, tr AS (SELECT * FROM sales WHERE {split_sql('"Id"')} = 'train'),
    m AS (SELECT median("LotFrontage") AS med FROM tr),
    f AS (SELECT "Electrical" AS top FROM tr WHERE "Electrical" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT "Id", round(coalesce("LotFrontage", med), 4) AS "LotFrontage", coalesce("Electrical", top) AS "Electrical",
      coalesce("GrLivArea", 0.0) AS "GrLivArea", coalesce(CASE WHEN "Priority" <> '5-LOW' THEN "Priority" END, 'None') AS "Priority"
    FROM sales CROSS JOIN m CROSS JOIN f""",
)
def impute_rules(spark, sf_dir):
    kept = kept_sales(spark, sf_dir, ["Id", "LotFrontage", "Electrical", "GrLivArea", "Priority"])
    s = hash_split(kept, "Id").withColumn("Priority", F.when(F.col("Priority") != "5-LOW", F.col("Priority")))
    rules = {
        "LotFrontage": ("median", None), "Electrical": ("mode", None), "GrLivArea": ("constant", 0.0), "Priority": ("constant", "None"),
    }
    out = RuleImputer(rules=rules).fit(s.filter("split = 'train'")).transform(s)
    return out.select("Id", F.round("LotFrontage", 4).alias("LotFrontage"), "Electrical", "GrLivArea", "Priority")


@query(
    "one_hot_long",
    f"""WITH {SPLIT_PARTS_SQL}, lv AS (SELECT brand_type, row_number() OVER (ORDER BY brand_type) - 1 AS slot
      FROM (SELECT DISTINCT brand_type FROM sp WHERE split = 'train'))
    SELECT row_id, slot::INTEGER AS slot, brand_type AS level FROM sp JOIN lv USING (brand_type)""",
)
def one_hot_long(spark, sf_dir):
    df = split_parts(spark, sf_dir).select("row_id", "split", "brand_type")
    model = OneHotLevels(cols=["brand_type"]).fit(df.filter("split = 'train'"))
    slots = model.transform(df).select("row_id", F.posexplode(vector_to_array("brand_type_ohe")).alias("slot", "on"))
    labels = F.lit(model.value("labels")[0])
    return slots.filter("on = 1").select("row_id", "slot", F.get(labels, F.col("slot")).alias("level"))


@query(
    "one_hot_wide",
    f"""WITH s AS (SELECT *, {split_sql('o_orderkey')} AS split FROM orders), lv AS (SELECT level, dense_rank() OVER (ORDER BY level) - 1 AS slot
      FROM (SELECT DISTINCT o_custkey::VARCHAR AS level FROM s WHERE split = 'train'))
    SELECT o_orderkey, (SELECT count(*) FROM lv) AS width, coalesce(slot, -1) AS slot FROM s LEFT JOIN lv ON level = o_custkey::VARCHAR""",
)
def one_hot_wide(spark, sf_dir):
    """Thousands of levels: their slots are a table, and the sparse vectors name the slot that is on."""
    df = hash_split(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "split", F.col("o_custkey").cast("string").alias("customer"))
    model = OneHotLevels(cols=["customer"]).fit(df.filter("split = 'train'"))
    vector = F.regexp_extract_all(F.col("customer_ohe").cast("string"), F.lit(r"(\d+)[,\]]"), F.lit(1))
    slots = model.transform(df).select("o_orderkey", vector.alias("v"))
    slot = F.when(F.size("v") > 1, F.get("v", F.lit(1)).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    return slots.select("o_orderkey", F.get("v", F.lit(0)).cast("bigint").alias("width"), slot.alias("slot"))


def _polynomial_sql(x: str, coefficients) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for k in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def _normal_sql(p: str) -> str:
    q, tail = f"({p} - 0.5)", f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    c = f"(0.180625 - {q} * {q})"
    ratio = lambda x, a, b: f"{_polynomial_sql(x, a)} / {_polynomial_sql(x, b)}"
    return f"""CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(c, CENTRAL_NUM, CENTRAL_DEN)}
      WHEN {tail} <= 5 THEN sign({q}) * {ratio(f'({tail} - 1.6)', NEAR_NUM, NEAR_DEN)}
      ELSE sign({q}) * {ratio(f'({tail} - 5.0)', FAR_NUM, FAR_DEN)} END"""


def _quantile_normal_sql(column: str, source: str, key: str) -> str:
    probs = ", ".join(f"{i / 199!r}" for i in range(200))
    return f"""knots AS (SELECT unnest(quantile_cont({column}, [{probs}])) AS k, unnest(range(200)) / 199.0::DOUBLE AS pos FROM {source}),
    t AS (SELECT k, min(pos) AS lo, max(pos) AS hi FROM knots GROUP BY k),
    n AS (SELECT *, lead(k) OVER (ORDER BY k) AS nk, lead(lo) OVER (ORDER BY k) AS nlo FROM t),
    u AS (SELECT s.{key} AS {key}, CASE WHEN s.{column} - 1e-7 < (SELECT min(k) FROM n) THEN 0.0
        WHEN s.{column} + 1e-7 > (SELECT max(k) FROM n) THEN 1.0
        WHEN s.{column} = n.k THEN (lo + hi) / 2 ELSE hi + (s.{column} - n.k) / (nk - n.k) * (nlo - hi) END AS p
      FROM {source} s ASOF JOIN n ON s.{column} >= n.k),
    c AS (SELECT {key}, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM u)
    SELECT {key}, round({_normal_sql('p')}, 5) + 0.0 AS z FROM c"""


@query("quantile_normal", f"WITH {_quantile_normal_sql('o_totalprice', 'orders', 'o_orderkey')}")
def quantile_normal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("z"))
    return QuantileNormal(cols=["z"]).fit(orders).transform(orders).withColumn("z", rounded(F.col("z"), 5))


@query("quantile_normal_ties", f"WITH x AS (SELECT p_partkey, p_size::DOUBLE AS s FROM part), {_quantile_normal_sql('s', 'x', 'p_partkey')}")
def quantile_normal_ties(spark, sf_dir):
    """A column of 50 distinct values: runs of equal quantiles."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("z"))
    return QuantileNormal(cols=["z"]).fit(part).transform(part).withColumn("z", rounded(F.col("z"), 5))


@query(
    "standard_scale",
    """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) + 0.0 AS price,
    round((month(o_orderdate) - avg(month(o_orderdate)) OVER ()) / stddev_pop(month(o_orderdate)) OVER (), 6) + 0.0 AS mon FROM orders""",
)
def standard_scale(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.month("o_orderdate").cast("double").alias("mon"))
    out = PopulationScaler(cols=["price", "mon"]).fit(o).transform(o)
    return out.select("o_orderkey", rounded(F.col("price")).alias("price"), rounded(F.col("mon")).alias("mon"))


@query(
    "sanitize",
    """SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS ratio, p_size FROM part""",
)
def sanitize(spark, sf_dir):
    infinity = F.lit(float("inf"))
    part = table(spark, sf_dir, "part")
    dirty = part.select(
        "p_partkey",
        F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice"))
        .when(F.col("p_size") % 2 == 0, infinity).otherwise(-infinity).alias("ratio"),
        "p_size",
        F.lit(None).cast("double").alias("empty"),
    )
    return Sanitizer().fit(dirty).transform(dirty)


SALES_TABLE = TableConfig(
    ordinal_levels={"Priority": PRIORITY_LEVELS},
    as_category=["HalfBath"],
    target_encoded=["Neighborhood", "BldgType"],
)


@query("feature_names")
def feature_names_query(spark, sf_dir):
    # Written once: every stage reads its columns instead of the joins.
    s = materialize(sales(spark, sf_dir).withColumnRenamed("SalePrice", "label"), "sales")
    return feature_names(fit_feature_space(s, SALES_TABLE))


@query("feature_vectors")
def feature_vectors(spark, sf_dir):
    """The whole feature pipeline, fitted on the training rows, on all rows."""
    s = materialize(hash_split(sales(spark, sf_dir).withColumnRenamed("SalePrice", "label"), "Id"), "sales")
    model = fit_feature_space(s.filter("split = 'train'").drop("split"), SALES_TABLE)
    out = model.transform(s).select("Id", "split", vector_to_array("features").alias("v"))
    return out.select("Id", "split", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


# --- least squares, metrics, ranking ---------------------------------------------------------


@query(
    "ols_group_fit",
    f"""WITH {PARTS_SQL} SELECT brand, count(*) AS n, round(regr_slope(label, x1), 6) AS slope,
    round(regr_intercept(label, x1), 6) AS intercept, round(regr_r2(label, x1), 6) AS r2 FROM parts GROUP BY 1""",
)
def ols_group_fit(spark, sf_dir):
    out = ols_by_group(parts(spark, sf_dir), ["brand"], "x1", "label")
    return out.select("brand", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


@query(
    "encode_fit_score",
    f"""WITH {SPLIT_PARTS_SQL}, e AS (
      SELECT sp.*, coalesce(b.te, g) AS te FROM sp CROSS JOIN (SELECT avg(label) AS g FROM sp WHERE split = 'train')
      LEFT JOIN {_target_mean_sql('brand_type')} b ON sp.brand_type = b.k),
    f AS (SELECT brand, regr_slope(label, x1) AS a, regr_intercept(label, x1) AS b, count(*) AS n FROM e WHERE split = 'train' GROUP BY 1),
    s AS (SELECT e.brand, label, a * x1 + b AS p, te FROM e JOIN f ON e.brand = f.brand WHERE split = 'test'),
    m AS (SELECT brand, count(*) AS n, sqrt(avg((label - p) ** 2)) AS rmse, avg(abs(label - p)) AS mae,
          CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(label) > 0 THEN 1 - avg((label - p) ** 2) / var_pop(label)
               WHEN avg((label - p) ** 2) = 0 THEN 1.0 ELSE 0.0 END AS r2, avg(te) AS mean_te FROM s GROUP BY 1)
    SELECT brand, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 5) AS r2, round(mean_te, 5) AS mean_te FROM m""",
)
def encode_fit_score(spark, sf_dir):
    """Split, encode on the training rows, one line per group, test metrics."""
    df = split_parts(spark, sf_dir)
    train = df.filter("split = 'train'")
    encoded = TargetEncoder(cols=["brand_type"], alpha=30.0).fit(train).transform(df)
    lines = ols_by_group(encoded.filter("split = 'train'"), ["brand"], "x1", "label").drop("n", "r2")
    scored = encoded.filter("split = 'test'").join(lines, "brand").withColumn("prediction", F.col("slope") * F.col("x1") + F.col("intercept"))
    m = metric_columns(F.col("label"), F.col("prediction"))
    return scored.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(m[k], digits).alias(k) for k, digits in {"rmse": 4, "mae": 4, "r2": 5}.items()],
        F.round(F.avg("TE_brand_type"), 5).alias("mean_te"),
    )


RIDGE_CTE = """r AS (SELECT count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, avg(label) AS my,
      var_pop(x1) * count(*) + 10 AS s11, var_pop(x2) * count(*) + 10 AS s22, covar_pop(x1, x2) * count(*) AS s12,
      covar_pop(x1, label) * count(*) AS s1y, covar_pop(x2, label) * count(*) AS s2y FROM parts),
    w AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2, m1, m2, my FROM r)"""
RIDGE_SQL = f"""WITH {PARTS_SQL}, {RIDGE_CTE}
    SELECT round(w1, 6) AS w1, round(w2, 5) + 0.0 AS w2, round(my - w1 * m1 - w2 * m2, 4) AS intercept FROM w"""


@query("ridge_closed_form", RIDGE_SQL)
def ridge_closed_form(spark, sf_dir):
    out = ridge_two_features(parts(spark, sf_dir), "x1", "x2", "label", 10.0)
    return out.select(F.round("w1", 6).alias("w1"), rounded(F.col("w2"), 5).alias("w2"), F.round("intercept", 4).alias("intercept"))


def _vectors(df):
    return VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df)


def _ridge(df):
    vectors = _vectors(df)
    return build("ridge", {"alpha": 10.0}, label_stats(vectors), 2).fit(vectors), vectors


@query("ridge_regressor", RIDGE_SQL)
def ridge_regressor(spark, sf_dir):
    """The same coefficients from the regressor of the model zoo."""
    model, _ = _ridge(parts(spark, sf_dir))
    w = [float(v) for v in model.coefficients]
    row = parts(spark, sf_dir).agg(F.lit(w[0]).alias("w1"), F.lit(w[1]).alias("w2"), F.lit(float(model.intercept)).alias("i"))
    return row.select(F.round("w1", 6).alias("w1"), rounded(F.col("w2"), 5).alias("w2"), F.round("i", 4).alias("intercept"))


CV_CTE = f"""{PARTS_SQL}, fp AS (SELECT *, {fold_sql('row_id')} AS fold FROM parts),
    l AS (SELECT 'x1' AS model, fold, label, x1 AS x FROM fp UNION ALL SELECT 'x2', fold, label, x2 FROM fp
          UNION ALL SELECT 'size', fold, label, size FROM fp WHERE size IS NOT NULL),
    c AS (SELECT a.model, k.fold, regr_slope(a.label, a.x) AS s, regr_intercept(a.label, a.x) AS i
          FROM l a JOIN (SELECT DISTINCT model, fold FROM l) k ON a.model = k.model AND a.fold <> k.fold GROUP BY 1, 2),
    fs AS (SELECT l.model, l.fold, sqrt(avg((label - s * x - i) ** 2)) AS rmse,
           1 - avg((label - s * x - i) ** 2) / var_pop(label) AS r2 FROM l JOIN c ON l.model = c.model AND l.fold = c.fold GROUP BY 1, 2),
    cv AS (SELECT model, avg(rmse) AS cv_rmse, avg(r2) AS cv_r2 FROM fs GROUP BY 1)"""


def _fold_scores(spark, sf_dir):
    return one_feature_cv(folded_parts(spark, sf_dir), ["x1", "x2", "size"], "label")


@query("cv_scores", f"WITH {CV_CTE} SELECT model, fold, round(rmse, 5) AS rmse, round(r2, 5) + 0.0 AS r2 FROM fs")
def cv_scores(spark, sf_dir):
    return _fold_scores(spark, sf_dir).select("model", "fold", F.round("rmse", 5).alias("rmse"), rounded(F.col("r2"), 5).alias("r2"))


@query("cv_mean_scores", f"WITH {CV_CTE} SELECT model, round(cv_rmse, 5) AS cv_rmse, round(cv_r2, 5) + 0.0 AS cv_r2 FROM cv")
def cv_mean_scores(spark, sf_dir):
    out = mean_over_folds(_fold_scores(spark, sf_dir))
    return out.select("model", F.round("cv_rmse", 5).alias("cv_rmse"), rounded(F.col("cv_r2"), 5).alias("cv_r2"))


@query(
    "cv_regressor",
    f"""WITH {CV_CTE} SELECT 'linear' AS model, round(cv_rmse, 4) AS cv_rmse, round(cv_r2, 4) AS cv_r2 FROM cv WHERE model = 'x1'""",
)
def cv_regressor(spark, sf_dir):
    """The same scores from the cross-validation loop over shared folds."""
    data = folded_parts(spark, sf_dir)

    def fit_transform(train):
        assembler = VectorAssembler(inputCols=["x1"], outputCol="features")
        return assembler.transform

    folds = prepare_folds(data, fit_transform, "row_id")
    cv = cross_validate("linear", {}, folds)
    for f in folds:
        f.release()
    return data.agg(F.lit("linear").alias("model"), F.round(F.lit(cv["cv_rmse"]), 4).alias("cv_rmse"), F.round(F.lit(cv["cv_r2"]), 4).alias("cv_r2"))


@query(
    "model_ranking",
    f"WITH {CV_CTE} SELECT model, round(cv_rmse, 5) AS cv_rmse, rank() OVER (ORDER BY cv_rmse) AS place FROM cv ORDER BY cv_rmse LIMIT 5",
)
def model_ranking(spark, sf_dir):
    results = mean_over_folds(_fold_scores(spark, sf_dir)).withColumn("status", F.lit("ok"))
    ranked = rank_models(results).limit(5)
    # A handful of rows, one per model: the place is their position.
    listed = ranked.agg(F.collect_list(F.struct("cv_rmse", "model")).alias("m")).select(F.posexplode(F.array_sort("m")).alias("i", "m"))
    return listed.select("m.model", F.round("m.cv_rmse", 5).alias("cv_rmse"), (F.col("i") + 1).cast("bigint").alias("place"))


BRAND_MEAN_SQL = f"""{PARTS_SQL}, pr AS (SELECT brand, avg(label) AS p FROM parts GROUP BY 1),
    j AS (SELECT row_id, parts.brand, label, pr.p FROM parts JOIN pr USING (brand))"""


def _aligned(spark, sf_dir):
    """Predictions in a table of their own, matched to the labels by row id."""
    p = parts(spark, sf_dir)
    predictions = p.join(p.groupBy("brand").agg(F.avg("label").alias("prediction")), "brand").select("row_id", "prediction")
    return p.select("row_id", "brand", "label").join(predictions, "row_id")


@query(
    "model_metrics",
    f"""WITH {BRAND_MEAN_SQL} SELECT brand, round(sqrt(avg((label - p) ** 2)), 5) AS rmse, round(avg(abs(label - p)), 5) AS mae,
    round(avg((label - p) ** 2), 4) AS mse FROM j GROUP BY 1""",
)
def model_metrics(spark, sf_dir):
    out = regression_metrics(_aligned(spark, sf_dir), by=["brand"])
    return out.select("brand", F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), F.round("mse", 4).alias("mse"))


@query(
    "residual_report",
    f"""WITH {BRAND_MEAN_SQL} SELECT 'brand mean' AS model_name, round(sqrt(avg((label - p) ** 2)), 5) AS rmse,
      round(avg(abs(label - p)), 5) AS mae, round(1 - avg((label - p) ** 2) / var_pop(label), 6) + 0.0 AS r2,
      round(avg(label - p), 5) + 0.0 AS mean_residual, round(stddev_pop(label - p), 5) AS std_residual,
      round(min(label - p), 5) AS min_residual, round(max(label - p), 5) AS max_residual,
      round(quantile_cont(label - p, 0.25), 5) AS q25_residual, round(median(label - p), 5) AS median_residual,
      round(quantile_cont(label - p, 0.75), 5) AS q75_residual, count(*) AS predictions_count,
      count(*) FILTER (p < label) AS underprediction_count, count(*) FILTER (p > label) AS overprediction_count FROM j""",
)
def residual_report(spark, sf_dir):
    out = model_report(_aligned(spark, sf_dir), "brand mean").select("model_name", "metrics.*", "residuals.*", "*")
    counts = ["predictions_count", "underprediction_count", "overprediction_count"]
    numbers = ["rmse", "mae", "mean_residual", "std_residual", "min_residual", "max_residual", "q25_residual", "median_residual", "q75_residual"]
    return out.select(
        F.lit("brand mean").alias("model_name"), rounded(F.col("r2")).alias("r2"), *[rounded(F.col(c), 5).alias(c) for c in numbers], *counts
    )


@query(
    "residual_statistics",
    f"""WITH {BRAND_MEAN_SQL} SELECT round(avg(label - p), 5) + 0.0 AS mean_residual, round(stddev_pop(label - p), 5) AS std_residual,
      round(quantile_cont(label - p, 0.25), 5) AS q25_residual FROM j""",
)
def residual_statistics_query(spark, sf_dir):
    out = residual_statistics(_aligned(spark, sf_dir))
    return out.select(*[rounded(F.col(c), 5).alias(c) for c in ("mean_residual", "std_residual", "q25_residual")])


@query(
    "predictions_report",
    f"""WITH {BRAND_MEAN_SQL} SELECT row_id, label AS "Actual", round(p, 5) AS "Predicted", round(label - p, 5) + 0.0 AS "Residual",
    round(abs(label - p), 5) AS "Absolute_Error", round(abs((label - p) / label * 100), 6) AS "Percent_Error" FROM j""",
)
def predictions_report_query(spark, sf_dir):
    out = predictions_report(_aligned(spark, sf_dir), keep=["row_id"])
    digits = {"Predicted": 5, "Residual": 5, "Absolute_Error": 5, "Percent_Error": 6}
    return out.select("row_id", "Actual", *[rounded(F.col(c), d).alias(c) for c, d in digits.items()])


@query(
    "log_scale_metrics",
    f"""WITH {PARTS_SQL}, f AS (SELECT regr_slope(ln(1 + label), x1) AS s, regr_intercept(ln(1 + label), x1) AS i FROM parts),
    e AS (SELECT ln(1 + label) AS y, s * x1 + i AS p FROM parts CROSS JOIN f)
    SELECT round(sqrt(avg((y - p) ** 2)), 8) AS rmse_log, round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2_log,
      round(sqrt(avg((exp(y) - exp(p)) ** 2)), 4) AS rmse, round(avg(abs(exp(y) - exp(p))), 4) AS mae FROM e""",
)
def log_scale_metrics(spark, sf_dir):
    p = VectorAssembler(inputCols=["x1"], outputCol="features").transform(
        parts(spark, sf_dir).withColumn("log_label", F.log1p("label"))
    )
    model = build("linear", {}, label_stats(p, "log_label"), 1, label="log_label").fit(p)
    out = metrics_on_both_scales(model.transform(p), "log_label", "prediction")
    return out.select(
        F.round("rmse_log", 8).alias("rmse_log"), F.round("r2_log", 6).alias("r2_log"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae")
    )


# --- models without SQL -------------------------------------------------------------------------


def _final_part(spark, sf_dir, features=("x1", "x2")):
    data = split_parts(spark, sf_dir)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return make_part(data, F.col("split") == "train", assembler.transform, ["row_id"])


def _better_than_mean(spark, sf_dir, kind, params):
    """Test rows, and 1 if the model's test error is not below that of the training mean."""
    part = _final_part(spark, sf_dir)
    scored = fit_part(kind, params, part).transform(part.valid)
    mean = part.train.agg(F.avg("label")).first()[0]
    y, p = F.col("label"), F.col("prediction")
    worse = F.avg((y - p) * (y - p)) >= F.avg((y - mean) * (y - mean))
    return scored.agg(F.count(y).alias("n"), worse.cast("bigint").alias("violations"))


BETTER_SQL = f"WITH {SPLIT_PARTS_SQL} SELECT count(*) AS n, 0::BIGINT AS violations FROM sp WHERE split = 'test'"


@query("forest_scores", BETTER_SQL)
def forest_scores(spark, sf_dir):
    return _better_than_mean(spark, sf_dir, "forest", {"n_estimators": 20, "max_depth": 6, "max_features": "sqrt"})


@query("gbt_scores", BETTER_SQL)
def gbt_scores(spark, sf_dir):
    return _better_than_mean(spark, sf_dir, "boosting", {"n_estimators": 10, "learning_rate": 0.3, "max_depth": 4, "subsample": 0.8})


#: Prices of parts are a line of their key; a hash of the key makes them less so.
NOISY_SQL = f"{PARTS_SQL}, noisy AS (SELECT * REPLACE (label + {hash_sql('noise', 'row_id')} % 50 AS label) FROM parts)"

STUMPS, STUMP_RATE = 4, 0.3


def _stumps_sql() -> str:
    """Boosted trees of one split each: the split with the least squared error, means of the residuals as outputs; the first tree counts
    whole, the others by the rate."""
    steps = ["s0 AS (SELECT *, 0.0::DOUBLE AS f0 FROM st)"]
    for k in range(1, STUMPS + 1):
        rate = 1.0 if k == 1 else STUMP_RATE
        steps.append(f"""g{k} AS (SELECT step, sum(n) OVER w AS nl, sum(r) OVER w AS sl, sum(n) OVER () AS nn, sum(r) OVER () AS ss, max(step) OVER () AS top
              FROM (SELECT step, count(*) AS n, sum(label - f{k - 1}) AS r FROM s{k - 1} WHERE split = 'train' GROUP BY step) WINDOW w AS (ORDER BY step)),
            b{k} AS (SELECT step AS cut, sl / nl AS low, (ss - sl) / (nn - nl) AS high FROM g{k} WHERE step < top
              ORDER BY sl * sl / nl + (ss - sl) * (ss - sl) / (nn - nl) DESC, step LIMIT 1),
            s{k} AS (SELECT s.*, f{k - 1} + {rate} * CASE WHEN step <= cut THEN low ELSE high END AS f{k} FROM s{k - 1} s CROSS JOIN b{k})""")
    scores = " UNION ALL ".join(
        f"""SELECT {k} AS n_estimators, round(sqrt(avg((label - f{k}) ** 2)), 4) AS rmse, round(avg(abs(label - f{k})), 4) AS mae,
        round(1 - avg((label - f{k}) ** 2) / var_pop(label), 6) AS r2 FROM s{STUMPS} WHERE split = 'test'"""
        for k in range(1, STUMPS + 1)
    )
    return f"WITH {NOISY_SQL}, st AS (SELECT label, floor(x1 / 40)::BIGINT AS step, {split_sql('row_id')} AS split FROM noisy), {', '.join(steps)} {scores}"


@query("boosted_stumps", _stumps_sql())
def boosted_stumps(spark, sf_dir):
    """Test errors after 1, 2, ... trees of one fitted ensemble."""
    data = hash_split(_noisy_parts(spark, sf_dir).withColumn("step", F.floor(F.col("x1") / 40).cast("double")), "row_id")
    assembler = VectorAssembler(inputCols=["step"], outputCol="features")
    part = make_part(data, F.col("split") == "train", assembler.transform, ["row_id"])
    model = fit_part("boosting", {"n_estimators": STUMPS, "learning_rate": STUMP_RATE, "max_depth": 1}, part)
    found = prefix_scores(model, part.valid)
    return found.select("n_estimators", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("elastic_net", BETTER_SQL)
def elastic_net(spark, sf_dir):
    return _better_than_mean(spark, sf_dir, "elastic_net", {"alpha": 0.01, "l1_ratio": 0.5})


@query("lasso", BETTER_SQL)
def lasso(spark, sf_dir):
    return _better_than_mean(spark, sf_dir, "lasso", {"alpha": 0.0005})


def _one_feature_sql(alpha: float, l1_ratio: float) -> str:
    return f"""WITH {SPLIT_PARTS_SQL},
    m AS (SELECT avg(x1) AS mx, avg(label) AS my, covar_pop(x1, label) AS c, var_pop(x1) AS v FROM sp WHERE split = 'train'),
    w AS (SELECT mx, my, sign(c) * greatest(abs(c) - {alpha * l1_ratio}, 0) / (v + {alpha * (1 - l1_ratio)}) AS w FROM m),
    e AS (SELECT label, my + w * (x1 - mx) AS p, w FROM sp CROSS JOIN w WHERE split = 'test')
    SELECT round(any_value(w), 6) AS w, round(sqrt(avg((label - p) ** 2)), 4) AS rmse, round(avg(abs(label - p)), 4) AS mae FROM e"""


def _one_feature_scores(spark, sf_dir, kind, params):
    part = _final_part(spark, sf_dir, ["x1"])
    model = fit_part(kind, params, part)
    out = regression_metrics(model.transform(part.valid))
    return out.select(
        F.round(F.lit(float(model.coefficients[0])), 6).alias("w"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae")
    )


@query("lasso_closed_form", _one_feature_sql(5.0, 1.0))
def lasso_closed_form(spark, sf_dir):
    """With one feature the solution is a soft threshold of the covariance."""
    return _one_feature_scores(spark, sf_dir, "lasso", {"alpha": 5.0})


@query("elastic_net_closed_form", _one_feature_sql(50.0, 0.4))
def elastic_net_closed_form(spark, sf_dir):
    return _one_feature_scores(spark, sf_dir, "elastic_net", {"alpha": 50.0, "l1_ratio": 0.4})


def _noisy_parts(spark, sf_dir):
    return parts(spark, sf_dir).withColumn("label", F.col("label") + seeded_hash(F.col("row_id"), "noise") % 50)


def _folds(data, k=3):
    data = add_folds(data, "row_id", k)
    assembler = VectorAssembler(inputCols=["x1", "x2"], outputCol="features")
    return prepare_folds(data, lambda train: assembler.transform, "row_id", k)


@query(
    "model_comparison",
    """SELECT * FROM (VALUES ('Ridge', 'ok', 0::BIGINT), ('Lasso', 'ok', 0), ('Linear', 'ok', 0), ('Broken', 'fail', 0)) AS m(model, status, violations)""",
)
def model_comparison(spark, sf_dir):
    models = {"Ridge": ("ridge", {"alpha": 10.0}), "Lasso": ("lasso", {"alpha": 0.0005}), "Linear": ("linear", {}), "Broken": ("none", {})}
    results, _, _ = evaluate_models(models, _folds(parts(spark, sf_dir)), _final_part(spark, sf_dir), "row_id", parallelism=3)
    # Scores of fitted models lie between those of the mean and of a perfect model; a failed one has a reason and no score.
    fitted = F.col("cv_r2").between(0, 1) & F.col("test_r2").between(0, 1) & (F.col("cv_rmse") > 0) & (F.col("test_rmse") > 0)
    right = F.when(F.col("status") == "ok", fitted).otherwise(F.col("cv_rmse").isNull() & F.col("error").isNotNull())
    return results.select("model", "status", F.when(right, 0).otherwise(1).cast("bigint").alias("violations"))


ALPHAS = [params["alpha"] for params in trial_params("Ridge", 3, SEED)]  # a seeded search is known beforehand


def _ridge_sql(rows: str, by: str, alphas: str) -> str:
    """w: coefficients for each (t, alpha) of ``alphas``, fitted on all of ``rows`` (or apart for each fold, on the other folds)."""
    fold, join, group = ("k.fold", f"JOIN (SELECT DISTINCT fold FROM {rows}) k ON a.fold <> k.fold", "GROUP BY k.fold") if by else ("0 AS fold", "", "")
    return f"""SELECT t, fold, m1, m2, my, ((s22 + alpha) * s1y - s12 * s2y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1,
        ((s11 + alpha) * s2y - s12 * s1y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2
      FROM (SELECT {fold}, avg(x1) AS m1, avg(x2) AS m2, avg(label) AS my, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22,
              covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, label) * count(*) AS s1y, covar_pop(x2, label) * count(*) AS s2y
            FROM {rows} a {join} {group}) CROSS JOIN ({alphas})"""


RIDGE_ERROR = "(label - my - w1 * (x1 - m1) - w2 * (x2 - m2)) ** 2"
TRIALS_SQL = " UNION ALL ".join(f"SELECT {t} AS t, {alpha!r}::DOUBLE AS alpha" for t, alpha in enumerate(ALPHAS))


def _search_sql(rows: str) -> str:
    return f"""wf AS ({_ridge_sql(rows, "fold", TRIALS_SQL)}),
      ef AS (SELECT t, fold, sqrt(avg({RIDGE_ERROR})) AS rmse, 1 - avg({RIDGE_ERROR}) / var_pop(label) AS r2 FROM {rows} JOIN wf USING (fold) GROUP BY 1, 2),
      trials AS (SELECT t, avg(rmse) AS cv_rmse, avg(r2) AS cv_r2 FROM ef GROUP BY 1)"""


@query(
    "tuning_trials",
    f"""WITH {NOISY_SQL}, fp AS (SELECT *, {fold_sql('row_id', 3)} AS fold FROM noisy), {_search_sql('fp')}
    SELECT 'Ridge' AS model, t::INTEGER AS trial, 'ok' AS status, round(cv_rmse, 5) AS cv_rmse, round(cv_r2, 6) AS cv_r2, 0::BIGINT AS violations FROM trials
    UNION ALL SELECT 'Lasso', unnest([0, 1, 2]), 'ok', NULL, NULL, 0
    UNION ALL SELECT 'Unknown', -1, 'skipped', NULL, NULL, 0""",
)
def tuning_trials(spark, sf_dir):
    tuned, trials = tune_models(["Ridge", "Lasso", "Unknown"], _folds(_noisy_parts(spark, sf_dir)), n_trials=3, parallelism=3)
    fitted = F.col("cv_r2").between(0, 1) & (F.col("cv_rmse") > 0) & F.col("params").isNotNull()
    right = F.when(F.col("status") == "ok", fitted).otherwise(F.col("cv_rmse").isNull())
    closed_form = F.col("model") == "Ridge"
    return trials.select(
        "model",
        F.coalesce("trial", F.lit(-1)).alias("trial"),
        "status",
        F.when(closed_form, F.round("cv_rmse", 5)).alias("cv_rmse"),
        F.when(closed_form, F.round("cv_r2", 6)).alias("cv_r2"),
        F.when(right, 0).otherwise(1).cast("bigint").alias("violations"),
    )


RANKED_SQL = "SELECT -1 AS t, 10.0::DOUBLE AS alpha UNION ALL SELECT -2, 0.0::DOUBLE"


@query(
    "final_ranking",
    f"""WITH {NOISY_SQL}, sp AS (SELECT *, {split_sql('row_id')} AS split, {fold_sql('row_id', 3)} AS fold FROM noisy),
      tr AS (SELECT * FROM sp WHERE split = 'train'), {_search_sql('tr')},
      best AS (SELECT t FROM trials ORDER BY cv_rmse, t LIMIT 1),
      w AS ({_ridge_sql('tr', '', f"{TRIALS_SQL} UNION ALL {RANKED_SQL}")})
    SELECT CASE WHEN t = -1 THEN 'Ridge' WHEN t = -2 THEN 'Linear' ELSE 'Ridge (Tuned)' END AS model,
      round(sqrt(avg({RIDGE_ERROR})), 5) AS test_rmse, round(1 - avg({RIDGE_ERROR}) / var_pop(label), 6) + 0.0 AS test_r2
    FROM sp, w WHERE split = 'test' AND (t < 0 OR t = (SELECT t FROM best)) GROUP BY t""",
)
def final_ranking_query(spark, sf_dir):
    """Two models by their test scores, and the one that has a search space again with what the search over the training folds found."""
    data = add_folds(hash_split(_noisy_parts(spark, sf_dir), "row_id"), "row_id", 3)
    assembler = VectorAssembler(inputCols=["x1", "x2"], outputCol="features")
    final = make_part(data, F.col("split") == "train", assembler.transform, ["row_id"])
    folds = prepare_folds(data.filter("split = 'train'").drop("split"), lambda train: assembler.transform, "row_id", 3)
    models = {"Linear": ("linear", {}), "Ridge": ("ridge", {"alpha": 10.0})}
    results, _, _ = evaluate_models(models, folds, final, "row_id", parallelism=2)
    tuned, _ = tune_models(["Ridge"], folds, n_trials=3, models=models)
    name = min(tuned, key=lambda m: (tuned[m]["best_cv_rmse"], m))
    kind, base = models[name]
    scored = fit_part(kind, {**base, **tuned[name]["best_params"]}, final).transform(final.valid)
    test = regression_metrics(scored).first()
    for part in [*folds, final]:
        part.release()
    ranked = final_ranking(results.filter("status = 'ok'"), name, test["rmse"], test["r2"])
    return ranked.select("model", F.round("test_rmse", 5).alias("test_rmse"), rounded(F.col("test_r2"), 6).alias("test_r2"))


# --- explanations ----------------------------------------------------------------------------------


def _explained(spark, sf_dir, k=2):
    df = parts(spark, sf_dir)
    model, vectors = _ridge(df)
    names = spark.createDataFrame([(0, "x1", "x1", "numeric"), (1, "x2", "x2", "numeric")], "idx int, name string, source_column string, kind string")
    explainer = explain.Explainer.fit(model, vectors, names, "row_id")
    rows = explainer.explain(model.transform(vectors))
    originals = explain.original_values(df, ["x1", "x2"])
    return explainer, explain.explain_topk(rows, explainer.slots(), k, originals=originals)


CONTRIB_CTE = f"""{PARTS_SQL}, {RIDGE_CTE},
    e AS (SELECT row_id, x1, x2, my, w1 * (x1 - m1) AS c1, w2 * (x2 - m2) AS c2 FROM parts CROSS JOIN w),
    lg AS (SELECT row_id, 'x1' AS f, 0 AS i, x1::VARCHAR AS v, c1 AS c FROM e UNION ALL SELECT row_id, 'x2', 1, x2::VARCHAR, c2 FROM e),
    rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(c) DESC, i) AS r FROM lg)"""


@query(
    "linear_contrib_topk",
    f"""WITH {CONTRIB_CTE} SELECT row_id, r::INTEGER AS rank, f AS feature_name, v AS original_value, round(c, 4) + 0.0 AS shap_value,
    CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END AS contribution_type FROM rk""",
)
def linear_contrib_topk(spark, sf_dir):
    _, df = _explained(spark, sf_dir)
    return explain.explode_explanations(df, "row_id").withColumn("shap_value", rounded(F.col("shap_value"), 4))


@query(
    "score_explain",
    f"""WITH {CONTRIB_CTE} SELECT e.row_id, round(my + c1 + c2, 4) AS predicted_price, round(my, 4) AS base_value,
      rk.f AS top_feature, round(rk.c, 4) + 0.0 AS top_shap FROM e JOIN rk ON e.row_id = rk.row_id AND rk.r = 1""",
)
def score_explain_query(spark, sf_dir):
    explainer, df = _explained(spark, sf_dir, 1)
    top = F.get("explanations", F.lit(0))
    return df.select(
        "row_id",
        F.round("prediction", 4).alias("predicted_price"),
        F.round(F.lit(explainer.base), 4).alias("base_value"),
        top["feature_name"].alias("top_feature"),
        rounded(top["shap_value"], 4).alias("top_shap"),
    )


@query(
    "waterfall",
    f"""WITH {CONTRIB_CTE}, b AS (SELECT e.row_id, my, c1 + c2 AS gap, rk.f, rk.c FROM e JOIN rk ON e.row_id = rk.row_id AND rk.r = 1)
    SELECT row_id, 0 AS step, 'Base Value' AS feature, round(my, 4) AS amount, round(my, 4) AS running_total FROM b
    UNION ALL SELECT row_id, 1, f, round(c, 4) + 0.0, round(my + c, 4) FROM b
    UNION ALL SELECT row_id, 2, 'Other features', round(gap - c, 4) + 0.0, round(my + gap, 4) FROM b
    UNION ALL SELECT row_id, 3, 'Predicted Price', round(gap, 4) + 0.0, round(my + gap, 4) FROM b""",
)
def waterfall(spark, sf_dir):
    explainer, df = _explained(spark, sf_dir, 1)
    out = explain.waterfall(df, "row_id", explainer.base)
    return out.select("row_id", "step", "feature", rounded(F.col("amount"), 4).alias("amount"), rounded(F.col("running_total"), 4).alias("running_total"))


@query(
    "impact_table",
    f"""WITH {CONTRIB_CTE} SELECT row_id, f AS "Feature", round(abs(c), 4) AS "Impact",
    CASE WHEN c > 0 THEN 'Positive' ELSE 'Negative' END AS "Direction", v AS "Value" FROM rk""",
)
def impact_table(spark, sf_dir):
    _, df = _explained(spark, sf_dir)
    return explain.impact_table(df, "row_id").withColumn("Impact", F.round("Impact", 4))


@query(
    "mean_abs_contribution",
    f"WITH {CONTRIB_CTE} SELECT f AS name, round(avg(abs(c)), 4) AS importance FROM lg GROUP BY 1",
)
def mean_abs_contribution(spark, sf_dir):
    explainer, df = _explained(spark, sf_dir)
    return explain.mean_abs_shap(df, explainer.slots()).withColumn("importance", F.round("importance", 4))


@query(
    "background_sample",
    f"SELECT o_orderkey FROM orders ORDER BY {hash_sql('background:42', 'o_orderkey')}, o_orderkey LIMIT 100",
)
def background_sample(spark, sf_dir):
    return explain.background_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def _tree_model(spark, sf_dir, kind, params):
    part = _final_part(spark, sf_dir)
    return fit_part(kind, params, part), part


def _additivity(spark, sf_dir, kind, params):
    model, _ = _tree_model(spark, sf_dir, kind, params)
    leaves = explain.leaf_table(explain.node_table(model))
    scored = model.transform(_vectors(parts(spark, sf_dir)))
    shap = explain.tree_shap(scored, leaves)
    total = F.aggregate("shap", F.lit(explain.base_value(leaves)), lambda a, b: a + b)
    return shap.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - F.col("prediction")) > 1e-6).alias("violations"))


@query("tree_shap_forest", "SELECT count(*) AS n, 0::BIGINT AS violations FROM part")
def tree_shap_forest(spark, sf_dir):
    """Base value and contributions add up to the prediction of every row."""
    return _additivity(spark, sf_dir, "forest", {"n_estimators": 10, "max_depth": 6, "max_features": None})


@query("tree_shap_boosting", "SELECT count(*) AS n, 0::BIGINT AS violations FROM part")
def tree_shap_boosting(spark, sf_dir):
    return _additivity(spark, sf_dir, "boosting", {"n_estimators": 8, "learning_rate": 0.3, "max_depth": 4})


# --- fixed values: a small ensemble, as a fitted model is stored ----------------------
# tree, weight, node, prediction, rows, left, right, feature, threshold
STORED_TREES = [
    (0, 1.0, 0, 3.0, 100.0, 1, 4, 0, 500.0),
    (0, 1.0, 1, 4.0, 60.0, 2, 3, 1, 20.0),
    (0, 1.0, 2, 10.0, 35.0, -1, -1, -1, None),
    (0, 1.0, 3, -4.0, 25.0, -1, -1, -1, None),
    (0, 1.0, 4, 6.0, 40.0, 5, 6, 0, 800.0),
    (0, 1.0, 5, 7.5, 30.0, -1, -1, -1, None),
    (0, 1.0, 6, 1.0, 10.0, -1, -1, -1, None),
    (1, 0.5, 0, 1.0, 100.0, 1, 2, 1, 30.5),
    (1, 0.5, 1, 2.0, 70.0, -1, -1, -1, None),
    (1, 0.5, 2, 3.0, 30.0, 3, 4, 2, 1400.0),
    (1, 0.5, 3, 5.0, 12.0, -1, -1, -1, None),
    (1, 0.5, 4, -3.0, 18.0, 5, 6, 1, 45.0),
    (1, 0.5, 5, 8.0, 6.0, -1, -1, -1, None),
    (1, 0.5, 6, 0.5, 12.0, -1, -1, -1, None),
]
# --- end of fixed values -----------------------------------------------------------------


def _subsets_sql(trees) -> str:
    """Contributions by their definition: the expected output for every subset of known features."""
    rows = ", ".join(str(tuple("NULL" if v is None else v for v in t)).replace("'NULL'", "NULL::DOUBLE") for t in trees)
    shares = {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}  # weights of subsets of 0, 1 and 2 of the other two features
    phi = lambda j: " + ".join(
        f"{shares[bin(s).count('1')]!r} * (max(v) FILTER (s = {s | 1 << j}) - max(v) FILTER (s = {s}))" for s in range(8) if not s >> j & 1
    )
    return f"""WITH RECURSIVE {PARTS_SQL}, nodes(tree, weight, id, prediction, n, l, r, f, t) AS (VALUES {rows}),
    x AS (SELECT row_id, unnest([x1, x2, label]) AS x, unnest([0, 1, 2]) AS f FROM parts),
    subsets AS (SELECT unnest(range(8)) AS s),
    walk(row_id, s, tree, id, p) AS (
      SELECT row_id, s, tree, 0, weight::DOUBLE FROM parts, subsets, nodes WHERE id = 0
      UNION ALL
      SELECT w.row_id, w.s, w.tree, c.id, w.p * CASE WHEN (w.s >> a.f) & 1 = 1 THEN ((x.x <= a.t) = (c.id = a.l))::INTEGER ELSE c.n::DOUBLE / a.n END
      FROM walk w JOIN nodes a ON a.tree = w.tree AND a.id = w.id AND a.l >= 0 JOIN nodes c ON c.tree = a.tree AND c.id IN (a.l, a.r)
      JOIN x ON x.row_id = w.row_id AND x.f = a.f),
    v AS (SELECT row_id, s, sum(p * prediction::DOUBLE) AS v FROM walk JOIN nodes USING (tree, id) WHERE l < 0 GROUP BY 1, 2)
    SELECT row_id, round({phi(0)}, 6) AS phi_x1, round({phi(1)}, 6) AS phi_x2, round({phi(2)}, 6) AS phi_price, round(max(v) FILTER (s = 0), 6) AS base
    FROM v GROUP BY 1"""


@query("tree_shap_values", _subsets_sql(STORED_TREES))
def tree_shap_values(spark, sf_dir):
    """Contributions of stored trees against the expected outputs of all subsets of features."""
    stored = spark.createDataFrame(STORED_TREES, "tree int, weight double, id int, prediction double, cover double, left int, right int, feature int, t double")
    leaves = explain.leaf_table(stored.withColumn("split", F.array("t")).withColumn("categories", F.lit(-1)).drop("t"))
    rows = VectorAssembler(inputCols=["x1", "x2", "label"], outputCol="features").transform(parts(spark, sf_dir))
    shap = explain.tree_shap(rows.select("row_id", "features"), leaves)
    base = F.round(F.lit(explain.base_value(leaves)), 6).alias("base")
    return shap.select("row_id", *[F.round(F.get("shap", F.lit(i)), 6).alias(f"phi_{c}") for i, c in enumerate(("x1", "x2", "price"))], base)


@query("feature_importance", "SELECT 2::BIGINT AS slots, 1.0::DOUBLE AS total, 0::BIGINT AS negative")
def feature_importance(spark, sf_dir):
    model, _ = _tree_model(spark, sf_dir, "forest", {"n_estimators": 10, "max_depth": 5, "max_features": None})
    names = spark.createDataFrame([(0, "x1", "x1", "numeric"), (1, "x2", "x2", "numeric")], "idx int, name string, source_column string, kind string")
    found = explain.feature_importance(model, names)
    return found.agg(F.count("name").alias("slots"), F.round(F.sum("importance"), 9).alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


# --- scoring jobs, stream, cache and log ------------------------------------------------------------

SCORED_SQL = f"""WITH {PARTS_SQL}, {RIDGE_CTE} SELECT row_id, round(my + w1 * (x1 - m1) + w2 * (x2 - m2), 4) AS predicted_price
    FROM parts CROSS JOIN w"""


def _ridge_pipeline(df):
    """The ridge model of two columns as a pipeline, with the checks its rows need."""
    model, _ = _ridge(df)
    steps = PipelineModel([VectorAssembler(inputCols=["x1", "x2"], outputCol="features", handleInvalid="keep"), model])
    return steps, {"x1": "double", "x2": "double"}


@query(
    "batch_score_summary",
    f"""WITH s AS ({SCORED_SQL}) SELECT count(*) AS n, round(min(predicted_price), 3) AS min_price,
    round(max(predicted_price), 3) AS max_price, round(avg(predicted_price), 3) AS avg_price FROM s""",
)
def batch_score_summary(spark, sf_dir):
    df = parts(spark, sf_dir)
    model, fields = _ridge_pipeline(df)
    scored = score(df, model, fields, "Ridge", ["row_id"], fields=fields, aliases={}).select(F.round("predicted_price", 4).alias("p"))
    return scored.agg(
        F.count("p").alias("n"), F.round(F.min("p"), 3).alias("min_price"), F.round(F.max("p"), 3).alias("max_price"), F.round(F.avg("p"), 3).alias("avg_price")
    )


@query("train_save_score", "SELECT count(*) AS n, 0::BIGINT AS unequal, 0::BIGINT AS not_additive, 0::BIGINT AS errors FROM part")
def train_save_score(spark, sf_dir):
    """A training job, its model read back, and both scoring functions: prices are equal and are the base value plus all
    contributions."""
    df = parts(spark, sf_dir).select("row_id", "label", "x1", "x2", "brand")
    roles = TableConfig(row_id="row_id", target="label", aliases={}, ordinal_levels={}, as_category=[], target_encoded=["brand"], domain_features=False)
    path = scratch_path(spark, "job")
    train_model(df, roles, {"Ridge": ("ridge", {"alpha": 10.0})}, run_tuning=False, k=2, output=path)
    saved, checks = load_model(spark, path), {"fields": {"x1": "double", "x2": "double", "brand": "string"}, "aliases": {}}
    plain = score(df, saved.pipeline, saved.expected, saved.name, ["row_id"], **checks)
    explained = score_explain(df, saved.pipeline, saved.explainer, saved.expected, saved.name, 1000, ["row_id"], **checks)
    sums = F.col("base_value") + F.aggregate("explanations", F.lit(0.0), lambda total, x: total + x.shap_value)
    both = plain.select("row_id", F.col("predicted_price").alias("price"), "error").join(explained.drop("error"), "row_id")
    return both.agg(
        F.count("row_id").alias("n"),
        F.count_if(F.abs(F.col("price") - F.col("predicted_price")) > 1e-9).alias("unequal"),
        F.count_if(F.abs(sums - F.col("price")) > 1e-6 * F.abs(F.col("price")) + 1e-6).alias("not_additive"),
        F.count("error").alias("errors"),
    )


@query("stream_score", SCORED_SQL)
def stream_score(spark, sf_dir):
    """The same rows through a file stream that ends when all is read, in two starts on two parts of the input."""
    df = parts(spark, sf_dir)
    model, fields = _ridge_pipeline(df)
    source, target = scratch_path(spark, "requests"), scratch_path(spark, "scores")
    for part in (0, 1):
        df.filter(F.col("row_id") % 2 == part).select("row_id", "x1", "x2").write.mode("append").parquet(source)
        requests = read_request_stream(spark, source, "parquet", schema="row_id bigint, x1 double, x2 double")
        scored = score_stream(requests, model, fields, "Ridge", ["row_id"], fields=fields, aliases={})
        scored = scored.select("row_id", F.round("predicted_price", 4).alias("predicted_price"))
        write_scores(scored, target).awaitTermination()
    return spark.read.schema(scored.schema).parquet(target)


@query(
    "stream_bodies",
    f"""WITH p AS ({SCORED_SQL}),
    r AS (SELECT row_id, u.i AS position, predicted_price FROM p CROSS JOIN (SELECT unnest([0, 1]) AS i) u WHERE row_id % 10 <> 0)
    SELECT row_id, position, CASE WHEN position = 0 THEN predicted_price END AS predicted_price,
      CASE WHEN position = 1 THEN 'x1 is not double' END AS error FROM r
    UNION ALL SELECT row_id, NULL, NULL, 'the body has no list of houses' FROM p WHERE row_id % 10 = 0""",
)
def stream_bodies(spark, sf_dir):
    """Request bodies as a stream with a sink for prices and one for what was refused: each body has a good and a bad record, each
    tenth body is no JSON."""
    df = parts(spark, sf_dir)
    model, fields = _ridge_pipeline(df)
    record = F.to_json(F.struct("x1", "x2"))
    body = F.concat(F.lit('{"houses": ['), record, F.lit(', {"x1": "none", "x2": 1.5}]}'))
    source, results, rejects = (scratch_path(spark, name) for name in ("bodies", "results", "rejects"))
    for part in (0, 1):
        some = df.filter(F.col("row_id") % 2 == part).select("row_id", F.when(F.col("row_id") % 10 == 0, "[").otherwise(body).alias("body"))
        some.write.mode("append").parquet(source)
        bodies = read_body_stream(spark, source, "row_id bigint, body string", "parquet")
        scored_by = lambda batch: score_bodies(batch, model, fields, "Ridge", "row_id", fields=fields, aliases={})
        write_bodies(bodies, scored_by, results, rejects).awaitTermination()
    prices = spark.read.parquet(results).select("row_id", "position", F.round("predicted_price", 4).alias("predicted_price"))
    return prices.unionByName(spark.read.parquet(rejects).select("row_id", "position", "error"), allowMissingColumns=True)


@query(
    "run_metrics_append",
    f"""WITH {PARTS_SQL} SELECT 'fit' AS run_name, 'metric' AS kind, 'rows' AS key, count(*)::VARCHAR AS value FROM parts
    UNION ALL SELECT 'fit', 'param', 'alpha', '10' UNION ALL SELECT 'job', 'metric', 'brands', count(DISTINCT brand)::VARCHAR FROM parts""",
)
def run_metrics_append(spark, sf_dir):
    path = scratch_path(spark, "run_metrics")
    p = parts(spark, sf_dir)
    job = RunLog(spark, path, "job")
    job.metrics(brands=p.select("brand").distinct().count())
    fit = job.child("fit")
    fit.params(alpha=10)
    fit.metrics(rows=p.count())
    return RunLog.read(spark, path).select("run_name", "kind", "key", "value")


@query("cache_read", f"WITH {PARTS_SQL} SELECT brand, count(*) AS n FROM parts GROUP BY 1")
def cache_read(spark, sf_dir):
    cache = ResultCache(spark, scratch_path(spark, "cache"))

    def compute():
        return parts(spark, sf_dir).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))

    cache.read_or_compute("brand_counts", lambda: compute().filter("n < 0"), {"source": "old"})
    cache.read_or_compute("brand_counts", compute, {"source": "part"})
    return cache.read_or_compute("brand_counts", lambda: compute().filter("n < 0"), {"source": "part"})


@query("cache_follows_input", f"WITH {PARTS_SQL} SELECT brand, count(*) AS n FROM parts GROUP BY 1")
def cache_follows_input(spark, sf_dir):
    """The folder grows between two reads of the cache, which has to notice; the third read finds the second's table."""
    cache, folder = ResultCache(spark, scratch_path(spark, "cache")), scratch_path(spark, "input")

    def read(spoiled=False):
        rows = spark.read.schema("row_id bigint, brand string").parquet(folder)
        counts = rows.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
        return cache.read_or_compute("brand_counts", lambda: counts.filter("n < 0") if spoiled else counts, source=rows)

    for part in (0, 1):
        rows = parts(spark, sf_dir).select("row_id", "brand").filter(F.col("row_id") % 2 == part)
        rows.write.mode("append").parquet(folder)
        read()
    return read(spoiled=True)


@query(
    "model_card",
    f"""WITH {PARTS_SQL}, {RIDGE_CTE} SELECT 'Ridge' AS name, round(sqrt(avg((label - my - w1 * (x1 - m1) - w2 * (x2 - m2)) ** 2)), 4) AS rmse,
    '10.0' AS alpha, 15 AS min_count FROM parts CROSS JOIN w""",
)
def model_card_query(spark, sf_dir):
    model, vectors = _ridge(parts(spark, sf_dir))
    metrics = regression_metrics(model.transform(vectors)).first().asDict()
    card = model_card(spark, "Ridge", metrics, {"alpha": 10.0}, TableConfig())
    return card.select(
        F.col("model_info.name").alias("name"),
        F.round("performance.rmse", 4).alias("rmse"),
        F.col("hyperparameters.alpha").alias("alpha"),
        F.col("feature_engineering.rare_pooler_min_count").cast("int").alias("min_count"),
    )
