"""Queries on preparation and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions import scalars
from tabwright.functions.nulls import col, fill, safe_double, text_or_nan
from tabwright.operators import profile
from tabwright.operators.domain import DomainFeatures, add_domain_features
from tabwright.operators.metrics import score_summary
from tabwright.operators.projection import (
    add_absent,
    align_columns,
    drop_identifier,
    keep_successful,
    merge_defaults,
    normalize_records,
    preview,
    separate_target,
    unique_columns,
    validate_batch,
    validation_error,
)
from tabwright.operators.quantiles import exact_quantiles
from tabwright.operators.scoring import batch_response, check_records, numbered, with_prediction_result
from tabwright.operators.split import add_folds, exact_split, hash_split
from tabwright.plans.registry import query
from tabwright.plans.views import PARTS_SQL, SALES_SQL, fold_sql, hash_sql, kept_sales, parts, rounded, sales, split_sql, table
from tabwright.session import scratch_path
from tabwright.sources.readers import explode_batches, read_large_json_batches, read_training_csv
from tabwright.sources.sinks import write_csv

SALES_NUMERIC = [
    "SalePrice", "YrSold", "MoSold", "YearBuilt", "YearRemodAdd", "OverallQual", "GrLivArea", "TotalBsmtSF",
    "1stFlrSF", "2ndFlrSF", "FullBath", "HalfBath", "BsmtFullBath", "WoodDeckSF", "LotArea", "LotFrontage",
]


@query(
    "split_summary",
    f"""WITH {SALES_SQL}
    SELECT {split_sql('"Id"')} AS split, count(*) AS n, round(avg("SalePrice"), 3) AS mean,
           round(stddev_samp("SalePrice"), 3) AS std FROM sales GROUP BY 1""",
)
def split_summary(spark, sf_dir):
    data = hash_split(separate_target(sales(spark, sf_dir), "SalePrice"), "Id")
    out = profile.target_summary(drop_identifier(data), "label")
    return out.select("split", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


@query(
    "exact_split",
    f"""WITH ranked AS (
      SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql('42', 'o_orderkey')}, o_orderkey) AS r,
             ceil(0.2 * count(*) OVER ()) AS wanted FROM orders)
    SELECT o_orderkey, CASE WHEN r <= wanted THEN 'test' ELSE 'train' END AS split FROM ranked""",
)
def exact_split_rows(spark, sf_dir):
    return exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "fold_sizes",
    f"SELECT {fold_sql('o_orderkey')} AS fold, count(*) AS n, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY 1",
)
def fold_sizes(spark, sf_dir):
    folds = add_folds(table(spark, sf_dir, "orders"), "o_orderkey")
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean"))


@query(
    "alias_default_validate",
    f"""WITH {SALES_SQL},
    raw AS (
      SELECT "Id", "1stFlrSF"::BIGINT::VARCHAR AS first_floor,
             CASE WHEN "Id" % 17 = 0 THEN 'large' ELSE "GrLivArea"::BIGINT::VARCHAR END AS area,
             CASE WHEN "Id" % 19 = 0 THEN -1.0 * "LotFrontage" ELSE "LotFrontage" END AS frontage,
             "YearBuilt" FROM sales),
    checked AS (
      SELECT "Id", try_cast(first_floor AS INTEGER) AS "1stFlrSF", try_cast(area AS INTEGER) AS "GrLivArea",
             frontage AS "LotFrontage", "YearBuilt",
             CASE WHEN area IS NOT NULL AND try_cast(area AS INTEGER) IS NULL THEN 'GrLivArea is not int'
                  WHEN try_cast(area AS INTEGER) IS NULL THEN 'field ''GrLivArea'' is required'
                  WHEN frontage < 0 THEN 'LotFrontage must not be negative' END AS error FROM raw)
    SELECT "Id", "1stFlrSF"::DOUBLE AS "1stFlrSF", "GrLivArea"::DOUBLE AS "GrLivArea", "LotFrontage", "YearBuilt", 5 AS "OverallQual", 'TA' AS "BsmtCond",
           0 AS "PoolArea", '0' AS "Fence", error, error IS NULL AS ok FROM checked""",
)
def alias_default_validate(spark, sf_dir):
    s = sales(spark, sf_dir)
    key = F.col("Id")
    records = s.select(
        key,
        col("1stFlrSF").cast("bigint").cast("string").alias("FirstFlrSF"),
        F.when(key % 17 == 0, "large").otherwise(F.col("GrLivArea").cast("bigint").cast("string")).alias("GrLivArea"),
        F.when(key % 19 == 0, -F.col("LotFrontage")).otherwise(F.col("LotFrontage")).alias("LotFrontage"),
        "YearBuilt",
    )
    checked = check_records(normalize_records(records), required=["GrLivArea"])
    merged = merge_defaults(checked, {"BsmtCond": "TA", "PoolArea": 0})
    aligned = align_columns(add_absent(merged, {"OverallQual": 5}), {"Fence": "string", "GrLivArea": "double"})
    return aligned.withColumn("ok", F.col("error").isNull()).select(
        "Id", *[col(c).cast("double").alias(c) for c in ("1stFlrSF", "GrLivArea")],
        "LotFrontage", "YearBuilt", "OverallQual", "BsmtCond", "PoolArea", "Fence", "error", "ok",
    )


@query(
    "row_validation_errors",
    f"""WITH {SALES_SQL},
    marked AS (SELECT CASE WHEN "YearRemodAdd" IS NULL THEN 'field ''YearRemodAdd'' is required'
        WHEN "LotArea" - 90000 < 0 THEN 'LotArea must not be negative'
        WHEN "TotalBsmtSF" - 50 < 0 THEN 'TotalBsmtSF must not be negative' END AS error FROM sales)
    SELECT coalesce(error, 'valid') AS error, count(*) AS n FROM marked GROUP BY 1""",
)
def row_validation_errors(spark, sf_dir):
    s = sales(spark, sf_dir).withColumns(
        {"LotArea": F.col("LotArea") - 90000, "TotalBsmtSF": F.col("TotalBsmtSF") - 50}
    )
    check = validate_batch(s)
    assert check["valid"], check["error"]
    error = validation_error(s.columns, required=["YearRemodAdd"])
    return s.select(F.coalesce(error, F.lit("valid")).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def _missing_sql(cols) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS missing,
            round((count(*) - count("{c}")) / count(*) * 100, 6) AS missing_pct FROM sales"""
        for c in cols
    )


@query(
    "missing_profile",
    f"""WITH {SALES_SQL} SELECT * FROM ({_missing_sql(SALES_NUMERIC + ['Electrical', 'Priority', 'Neighborhood'])})
    WHERE missing > 0 ORDER BY missing DESC, "column" LIMIT 20""",
)
def missing_profile(spark, sf_dir):
    out = profile.missing_profile(sales(spark, sf_dir))
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "missing_totals",
    f"""WITH {SALES_SQL}, c AS (
      SELECT count(*) AS rows, {', '.join(f'count(*) - count("{c}") AS m{i}' for i, c in enumerate(SALES_NUMERIC + ['Electrical']))}
      FROM sales)
    SELECT rows, 21::BIGINT AS columns, ({' + '.join(f'm{i}' for i in range(17))}) AS missing_cells,
           round(({' + '.join(f'm{i}' for i in range(17))}) / (rows * 21) * 100, 6) AS missing_pct,
           ({' + '.join(f'(m{i} > 0)::BIGINT' for i in range(17))}) AS columns_with_missing FROM c""",
)
def missing_totals(spark, sf_dir):
    return profile.missing_totals(sales(spark, sf_dir)).withColumn("missing_pct", F.round("missing_pct", 6))


def _describe_sql(cols) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS count, round(avg("{c}"), 3) AS mean,
            round(stddev_samp("{c}"), 3) AS std, round(min("{c}")::DOUBLE, 3) AS min,
            round(quantile_cont("{c}"::DOUBLE, 0.25), 3) AS q25, round(median("{c}"::DOUBLE), 3) AS median,
            round(quantile_cont("{c}"::DOUBLE, 0.75), 3) AS q75, round(max("{c}")::DOUBLE, 3) AS max FROM sales"""
        for c in cols
    )


@query("describe_numeric", f"WITH {SALES_SQL} {_describe_sql(SALES_NUMERIC)}")
def describe_numeric(spark, sf_dir):
    out = profile.describe(kept_sales(spark, sf_dir, SALES_NUMERIC), SALES_NUMERIC)
    return out.select("column", "count", *[F.round(c, 3).alias(c) for c in out.columns[2:]])


@query(
    "dtype_profile",
    """SELECT * FROM (
      SELECT 0 AS position, 'p_partkey' AS "column", 'bigint' AS dtype, count(p_partkey) AS non_null FROM part
      UNION ALL SELECT 1, 'p_name', 'string', count(p_name) FROM part
      UNION ALL SELECT 2, 'p_brand', 'string', count(p_brand) FROM part
      UNION ALL SELECT 3, 'p_type', 'string', count(p_type) FROM part
      UNION ALL SELECT 4, 'p_size', 'int', count(p_size) FROM part
      UNION ALL SELECT 5, 'p_retailprice', 'double', count(p_retailprice) FROM part)""",
)
def dtype_profile(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    # A file with repeated headers: the first column of a name is kept.
    doubled = part.select(*part.columns, F.lit(0).alias("again"))
    return profile.column_types(unique_columns(doubled, [*part.columns, "p_size"]))


@query("preview_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_rows(spark, sf_dir):
    return preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


def _histogram_sql(column: str, source: str, bins: int) -> str:
    return f"""SELECT '{column}' AS "column", b.bin::INTEGER AS bin, round(low + b.bin * step, 4) AS low,
        round(low + (b.bin + 1) * step, 4) AS high, coalesce(c.n, 0) AS n
      FROM (SELECT min("{column}")::DOUBLE AS low, (max("{column}")::DOUBLE - min("{column}")::DOUBLE) / {bins} AS step FROM {source}) e
      CROSS JOIN range({bins}) b(bin)
      LEFT JOIN (SELECT least(floor(("{column}"::DOUBLE - low) / step), {bins - 1})::INTEGER AS bin, count(*) AS n
        FROM {source} CROSS JOIN (SELECT min("{column}")::DOUBLE AS low,
             (max("{column}")::DOUBLE - min("{column}")::DOUBLE) / {bins} AS step FROM {source})
        WHERE "{column}" IS NOT NULL GROUP BY 1) c ON b.bin = c.bin"""


@query(
    "histogram_target",
    f"""WITH {SALES_SQL} {_histogram_sql('SalePrice', 'sales', 50)} UNION ALL {_histogram_sql('GrLivArea', 'sales', 50)}
    UNION ALL {_histogram_sql('MoSold', 'sales', 50)}""",
)
def histogram_target(spark, sf_dir):
    out = profile.histogram(kept_sales(spark, sf_dir, ["SalePrice", "GrLivArea", "MoSold"]), ["SalePrice", "GrLivArea", "MoSold"], 50)
    return out.select("column", "bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query(
    "target_kde",
    """WITH s AS (SELECT count(*) AS n, stddev_samp(o_totalprice) * count(*) ** -0.2 AS w, min(o_totalprice) AS low,
           (max(o_totalprice) - min(o_totalprice)) / 39 AS step FROM orders),
    g AS (SELECT i AS idx, low + i * step AS x, n, w FROM s CROSS JOIN range(40) r(i))
    SELECT idx::INTEGER AS idx, round(x, 3) AS x,
      round(sum(exp(-0.5 * ((x - o_totalprice) / w) * ((x - o_totalprice) / w))) / (any_value(n) * any_value(w) * sqrt(2 * pi())) * 1e6, 6) AS density_1e6
    FROM g CROSS JOIN orders GROUP BY idx, x""",
)
def target_kde(spark, sf_dir):
    out = profile.kernel_density(table(spark, sf_dir, "orders"), "o_totalprice", grid_size=40)
    return out.select("idx", F.round("x", 3).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density_1e6"))


@query(
    "corr_topk",
    f"""WITH {SALES_SQL}, c AS (SELECT 'SalePrice' AS "column", 1.0::DOUBLE AS corr UNION ALL
    {' UNION ALL '.join(f'''SELECT '{c}', corr("{c}"::DOUBLE, "SalePrice") FROM sales''' for c in SALES_NUMERIC if c != 'SalePrice')})
    SELECT "column", round(corr, 6) AS corr FROM c ORDER BY abs(corr) DESC, "column" LIMIT 10""",
)
def corr_topk(spark, sf_dir):
    out = profile.top_correlated(sales(spark, sf_dir), "SalePrice", 10, SALES_NUMERIC)
    return out.withColumn("corr", F.round("corr", 6))


def _corr_sql(cols) -> str:
    pairs = [(a, b) for a in cols for b in cols]
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, {"1.0::DOUBLE" if a == b else f'round(corr("{a}"::DOUBLE, "{b}"::DOUBLE), 6) + 0.0'} AS corr FROM {"(SELECT 1)" if a == b else "sales"}"""
        for a, b in pairs
    )


CORR_COLUMNS = ["SalePrice", "OverallQual", "GrLivArea", "TotalBsmtSF", "LotArea", "MoSold"]


@query("corr_matrix", f"WITH {SALES_SQL} {_corr_sql(CORR_COLUMNS)}")
def corr_matrix(spark, sf_dir):
    return profile.correlation_matrix(sales(spark, sf_dir), CORR_COLUMNS).withColumn("corr", rounded(F.col("corr")))


@query("corr_matrix_wide", f"WITH {SALES_SQL} SELECT * FROM ({_corr_sql(SALES_NUMERIC)}) WHERE a < b")
def corr_matrix_wide(spark, sf_dir):
    """Many columns, each pair once."""
    out = profile.correlation_matrix(kept_sales(spark, sf_dir, SALES_NUMERIC), SALES_NUMERIC).filter("a < b")
    return out.withColumn("corr", rounded(F.col("corr")))


EDGE_SQL = """edge AS (SELECT o_totalprice AS x, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey::DOUBLE END AS y,
    3.0::DOUBLE AS constant, NULL::DOUBLE AS nothing FROM orders)"""


def edge(spark, sf_dir):
    """A plain column, one with NaN, a constant one and an empty one."""
    y = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_custkey").cast("double"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("x"), y.alias("y"), F.lit(3.0).alias("constant"), F.lit(None).cast("double").alias("nothing")
    )


@query(
    "corr_edges",
    f"""WITH {EDGE_SQL}, n AS (SELECT unnest(['x', 'y', 'constant', 'nothing']) AS c), r AS (SELECT round(corr(x, y), 6) AS xy FROM edge)
    SELECT a.c AS a, b.c AS b, CASE WHEN a.c IN ('x', 'y') AND b.c IN ('x', 'y') THEN CASE WHEN a.c = b.c THEN 1.0 ELSE xy END END AS corr
    FROM n AS a CROSS JOIN n AS b CROSS JOIN r""",
)
def corr_edges(spark, sf_dir):
    """No correlation with a constant or an empty column; NaN is missing."""
    return profile.correlation_matrix(edge(spark, sf_dir)).withColumn("corr", F.round("corr", 6))


@query(
    "describe_edges",
    f"WITH {EDGE_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM edge"""
        for c in ("x", "y", "constant", "nothing")
    ),
)
def describe_edges(spark, sf_dir):
    out = profile.describe(edge(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "median", "q75")})


@query(
    "quantiles_many_rows",
    """SELECT unnest([0.0, 0.1, 0.5, 0.99, 1.0]) AS p, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.99, 1.0])), 6) AS price,
    unnest(quantile_cont(l_quantity, [0.0, 0.1, 0.5, 0.99, 1.0])) AS quantity FROM lineitem""",
)
def quantiles_many_rows(spark, sf_dir):
    """Exact quantiles of a column with many values and of one with few, by the same steps at any size."""
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), {"l_extendedprice": probs, "l_quantity": probs})
    rows = list(zip(probs, found["l_extendedprice"], found["l_quantity"]))
    return spark.createDataFrame(rows, "p double, price double, quantity double").withColumn("price", F.round("price", 6))


CODES_SQL = "codes AS (SELECT p_partkey AS id, (p_partkey % 7)::VARCHAR || CASE WHEN p_partkey % 5 = 0 THEN 'F' ELSE 'D' END AS code, p_size AS size FROM part)"


@query("csv_codes_stay_text", f"WITH {CODES_SQL} SELECT id, code, size::BIGINT AS size FROM codes")
def csv_codes_stay_text(spark, sf_dir):
    """Codes such as 1F and 2D are text, not numbers."""
    suffix = F.when(F.col("p_partkey") % 5 == 0, "F").otherwise("D")
    codes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat((F.col("p_partkey") % 7).cast("string"), suffix).alias("code"), F.col("p_size").alias("size"))
    path = scratch_path(spark, "codes")
    write_csv(codes, path)
    return read_training_csv(spark, path)


@query(
    "group_count_mean",
    f"""WITH {SALES_SQL} SELECT "Electrical", count("SalePrice") AS count, round(avg("SalePrice"), 3) AS mean
    FROM sales GROUP BY 1""",
)
def group_count_mean(spark, sf_dir):
    out = profile.group_count_mean(sales(spark, sf_dir), "Electrical", "SalePrice")
    return out.withColumn("mean", F.round("mean", 3))


@query(
    "distinct_levels",
    f"""WITH {SALES_SQL} SELECT DISTINCT 'Electrical' AS "column", coalesce("Electrical", 'nan') AS level FROM sales
    UNION ALL SELECT DISTINCT 'BldgType', coalesce("BldgType", 'nan') FROM sales""",
)
def distinct_levels(spark, sf_dir):
    return profile.distinct_levels(sales(spark, sf_dir), ["Electrical", "BldgType"])


DOMAIN_SQL = f"""WITH {SALES_SQL},
    cap AS (SELECT quantile_cont("LotArea", 0.99) AS q FROM sales),
    m AS (SELECT *, 2 * pi() * (coalesce("MoSold", 6) / 12.0::DOUBLE) AS angle FROM sales)
    SELECT "Id",
      (coalesce("TotalBsmtSF", 0) + coalesce("1stFlrSF", 0) + coalesce("2ndFlrSF", 0))::DOUBLE AS "TotalSF",
      (coalesce("FullBath", 0) + 0.5 * coalesce("HalfBath", 0) + coalesce("BsmtFullBath", 0))::DOUBLE AS "TotalBath",
      (CASE WHEN "YrSold" - "YearBuilt" < 0 THEN 0 ELSE "YrSold" - "YearBuilt" END)::DOUBLE AS "HouseAge",
      (CASE WHEN "YrSold" - "YearRemodAdd" < 0 THEN 0 ELSE "YrSold" - "YearRemodAdd" END)::DOUBLE AS "RemodAge",
      CASE WHEN "YearRemodAdd" IS NULL OR "YearRemodAdd" <> "YearBuilt" THEN 1 ELSE 0 END AS "IsRemodeled",
      CASE WHEN "2ndFlrSF" > 0 THEN 1 ELSE 0 END AS "Has2ndFlr",
      coalesce("WoodDeckSF", 0)::DOUBLE AS "TotalPorchSF",
      ("OverallQual" * "GrLivArea")::DOUBLE AS "Quality_Area_Interaction",
      round(sin(angle), 6) + 0.0 AS "MoSold_sin", round(cos(angle), 6) + 0.0 AS "MoSold_cos",
      coalesce("Neighborhood", 'nan') || '_' || coalesce("BldgType", 'nan') AS "Loc_Type",
      round(CASE WHEN "LotArea" > q THEN q ELSE "LotArea" END, 4) AS "LotArea_clip"
    FROM m CROSS JOIN cap"""
DOMAIN_COLUMNS = [
    "TotalSF", "TotalBath", "HouseAge", "RemodAge", "IsRemodeled", "Has2ndFlr", "TotalPorchSF",
    "Quality_Area_Interaction", "MoSold_sin", "MoSold_cos", "Loc_Type", "LotArea_clip",
]


def _domain_result(df):
    digits = {"MoSold_sin": 6, "MoSold_cos": 6, "LotArea_clip": 4}
    return df.select("Id", *[rounded(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in DOMAIN_COLUMNS])


@query("domain_features", DOMAIN_SQL)
def domain_features(spark, sf_dir):
    df = kept_sales(spark, sf_dir)
    return _domain_result(DomainFeatures().fit(df).transform(df))


@query("domain_features_frame_scope", DOMAIN_SQL)
def domain_features_frame_scope(spark, sf_dir):
    """The stateless form: the clip comes from the frame being transformed."""
    return _domain_result(add_domain_features(kept_sales(spark, sf_dir)))


@query(
    "quantile_clip",
    """WITH cap AS (SELECT quantile_cont(l_extendedprice, 0.99) AS q FROM lineitem)
    SELECT l_returnflag, count(*) AS n, sum(CASE WHEN l_extendedprice > q THEN 1 ELSE 0 END)::BIGINT AS clipped,
           round(max(least(l_extendedprice, q)), 4) AS top FROM lineitem CROSS JOIN cap GROUP BY 1""",
)
def quantile_clip(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("LotArea"))
    clipped = DomainFeatures().fit(li).transform(li)
    return clipped.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("LotArea_clip") < F.col("LotArea")).alias("clipped"),
        F.round(F.max("LotArea_clip"), 4).alias("top"),
    )


@query(
    "log_target",
    """SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS log_price, round(exp(ln(1 + o_totalprice)) - 1, 3) AS price
    FROM orders""",
)
def log_target(spark, sf_dir):
    logged = table(spark, sf_dir, "orders").select("o_orderkey", scalars.log_target(F.col("o_totalprice")).alias("l"))
    return logged.select("o_orderkey", F.round("l", 9).alias("log_price"), F.round(scalars.unlog_target(F.col("l")), 3).alias("price"))


@query(
    "safe_cast_fill",
    """SELECT p_partkey, coalesce(try_cast(CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_size::VARCHAR END AS DOUBLE), 0.0::DOUBLE) AS number,
    coalesce(CASE WHEN p_size % 7 <> 0 THEN p_brand END, 'nan') AS text FROM part""",
)
def safe_cast_fill(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mixed = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.col("p_size").cast("string"))
    return part.select(
        "p_partkey",
        fill(safe_double(mixed), 0.0).alias("number"),
        text_or_nan(F.when(F.col("p_size") % 7 != 0, F.col("p_brand"))).alias("text"),
    )


@query(
    "format_text",
    """WITH c AS (SELECT p_partkey, p_retailprice - 1000 AS v, p_size, p_size / 50.0::DOUBLE AS conf,
        CASE p_partkey % 3 WHEN 0 THEN 'cat__' WHEN 1 THEN 'TargetEncoder_' ELSE '' END || 'cat__' || p_brand AS raw FROM part)
    SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice_) AS price, format('{:.1f}', conf * 100) || '%' AS confidence,
      CASE WHEN conf >= 0.8 THEN 'green' WHEN conf >= 0.6 THEN 'orange' ELSE 'red' END AS color,
      CASE WHEN conf >= 0.9 THEN 'green' WHEN conf >= 0.7 THEN 'yellow' ELSE 'red' END AS level,
      CASE WHEN v > 0 THEN 'positive' ELSE 'negative' END AS sign,
      CASE WHEN v > 0 THEN 'raises' ELSE 'lowers' END || ' the price by $' || format('{:,.2f}', abs(v)) || ' through size=' || p_size AS sentence,
      regexp_replace(raw, '^(TargetEncoder_|cat__)', '') AS feature
    FROM (SELECT *, v + 1000 AS p_retailprice_ FROM c)""",
)
def format_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    v, confidence = F.col("p_retailprice") - 1000, F.col("p_size") / 50.0
    prefix = F.element_at(F.array(F.lit("cat__"), F.lit("TargetEncoder_"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return part.select(
        "p_partkey",
        scalars.currency_text(v + 1000).alias("price"),
        scalars.percent_text(confidence).alias("confidence"),
        scalars.confidence_color(confidence).alias("color"),
        scalars.confidence_level(confidence).alias("level"),
        scalars.contribution_type(v).alias("sign"),
        scalars.contribution_sentence(v, F.lit("size"), F.col("p_size")).alias("sentence"),
        scalars.clean_feature_name(F.concat(prefix, F.lit("cat__"), F.col("p_brand"))).alias("feature"),
    )


@query(
    "json_batch_score",
    """WITH r AS (
      SELECT event_id, 0 AS position, json_extract(props, '$.k')::INTEGER AS area FROM events
      UNION ALL SELECT event_id, 1, (json_extract(props, '$.k')::INTEGER) * 2 FROM events
      UNION ALL SELECT event_id, 2, NULL FROM events)
    SELECT event_id, 3::BIGINT AS total_processed,
      count(area) AS successful, sum(area * 100.0)::DOUBLE AS total_price,
      max(CASE WHEN position = 1 THEN area * 100.0 END)::DOUBLE AS second_price FROM r GROUP BY event_id""",
)
def json_batch_score(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    record = lambda c: F.concat(F.lit('{"LotArea": '), c.cast("string"), F.lit("}"))
    body = F.concat(F.lit('{"houses": ['), record(k), F.lit(", "), record(k * 2), F.lit(', {"LotArea": "none"}]}'))
    rows = explode_batches(events.select("event_id", body.alias("body")), "body", {"LotArea": "int"}, keep=["event_id"])
    scored = with_prediction_result(rows.withColumn("prediction", F.col("LotArea") * 100.0), "linear")
    # The three records of a body are one bounded group.
    response = batch_response(scored, "position", by=["event_id"])
    prices = F.transform("predictions", lambda p: p["predicted_price"])
    return response.select(
        "event_id",
        "total_processed",
        F.size("predictions").cast("bigint").alias("successful"),
        F.aggregate(prices, F.lit(0.0), lambda a, b: a + b).alias("total_price"),
        F.get(prices, F.lit(1)).alias("second_price"),
    )


@query(
    "json_large_body",
    f"""WITH {PARTS_SQL} SELECT 'list=' || (row_id % 3)::VARCHAR AS list, row_number() OVER (PARTITION BY row_id % 3 ORDER BY row_id) - 1 AS position,
    row_id::INTEGER AS row_id, label, "type" FROM parts""",
)
def json_large_body(spark, sf_dir):
    """Three bodies that hold all rows, read in byte ranges of 64 KB."""
    p = parts(spark, sf_dir)
    record = F.concat(F.to_json(F.struct("row_id", "label", "type")), F.lit(","))
    rows = p.select((F.col("row_id") % 3).alias("list"), F.lit(1).alias("part"), "row_id", record.alias("value"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit('{"of": {"houses": [{}]}, "houses": [').alias("value")), F.struct(F.lit(2).alias("part"), F.lit("{}]}").alias("value"))))
    ends = rows.select("list").distinct().select("list", ends.alias("e")).select("list", "e.part", F.lit(0).alias("row_id"), "e.value")
    folder = scratch_path(spark, "bodies")
    dealt = rows.unionByName(ends).repartition("list").sortWithinPartitions("list", "part", "row_id")
    dealt.select("list", "value").write.partitionBy("list").text(folder)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        read = read_large_json_batches(spark, folder, {"row_id": "int", "label": "double", "type": "string"})
    finally:
        spark.conf.set(key, before)
    of = F.regexp_extract("source", "list=[0-9]+", 0).alias("list")
    return read.filter("row_id IS NOT NULL OR error IS NOT NULL").select(of, "position", "row_id", "label", "type")


@query(
    "csv_roundtrip",
    f"""WITH {PARTS_SQL} SELECT row_id, label, size::DOUBLE AS size, "type", CASE WHEN row_id % 6 = 0 THEN NULL ELSE brand END AS brand FROM parts""",
)
def csv_roundtrip(spark, sf_dir):
    # "NA", an empty field and "None" all stand for missing in the file.
    token = F.element_at(F.array(F.lit("NA"), F.lit("None")), (F.col("row_id") % 2 + 1).cast("int"))
    df = parts(spark, sf_dir).select(
        "row_id", "label", "size", F.coalesce("type", F.lit("NA")).alias("type"),
        F.when(F.col("row_id") % 6 == 0, token).otherwise(F.col("brand")).alias("brand"),
    )
    path = scratch_path(spark, "csv")
    write_csv(df, path)
    return read_training_csv(spark, path, {"size": "double"})


@query(
    "score_summary",
    """SELECT count(*) FILTER (p_size % 4 <> 0) AS n, min(p_retailprice) FILTER (p_size % 4 <> 0) AS min_price,
    max(p_retailprice) FILTER (p_size % 4 <> 0) AS max_price, round(avg(p_retailprice) FILTER (p_size % 4 <> 0), 4) AS avg_price,
    round(0.85::DOUBLE, 4) AS avg_confidence FROM part""",
)
def score_summary_query(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("prediction"), F.lit(None).cast("string").alias("error")
    )
    out = score_summary(with_prediction_result(part, "linear"))
    return out.withColumns({"avg_price": F.round("avg_price", 4), "avg_confidence": F.round("avg_confidence", 4)})


@query(
    "numbered_results",
    """SELECT p_partkey + 1 AS "No", p_retailprice AS "Predicted Price", 0.85::DOUBLE AS "Confidence", 'linear' AS "Model"
    FROM part WHERE p_size % 4 <> 0""",
)
def numbered_results(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("prediction"),
        F.lit(None).cast("string").alias("error"),
    )
    return numbered(keep_successful(with_prediction_result(part, "linear")), "p_partkey")
