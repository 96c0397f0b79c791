"""Views of the driver tables: sales-shaped orders and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwright.operators.split import add_folds, hash_split
from tabwright.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)  # no negative zero


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sale per order.  Line items are summed per order before the join;
    join strategies are left to the optimizer, which knows the sizes."""
    li = table(spark, sf_dir, "lineitem")
    quantity = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    lines = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        quantity("A").alias("qty_a"),
        quantity("N").alias("qty_n"),
        quantity("R").alias("qty_r"),
        F.max("l_extendedprice").alias("top_price"),
        F.min("l_extendedprice").alias("low_price"),
        F.max("l_linenumber").alias("last_line"),
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    key, customer_key = F.col("o_orderkey"), F.col("o_custkey")
    return joined.select(
        key.alias("Id"),
        F.col("o_totalprice").alias("SalePrice"),
        F.col("n_name").alias("Neighborhood"),
        F.col("c_mktsegment").alias("BldgType"),
        F.col("o_orderpriority").alias("Priority"),
        F.when(key % 9 != 0, F.col("o_orderstatus")).alias("Electrical"),
        F.year("o_orderdate").cast("int").alias("YrSold"),
        F.when(key % 11 != 0, F.month("o_orderdate")).cast("int").alias("MoSold"),
        (1990 + customer_key % 12).cast("int").alias("YearBuilt"),
        F.when(key % 13 != 0, 1990 + (customer_key + key) % 12).cast("int").alias("YearRemodAdd"),
        (1 + key % 10).cast("int").alias("OverallQual"),
        F.col("qty").alias("GrLivArea"),
        F.col("qty_a").alias("TotalBsmtSF"),
        F.col("qty_n").alias("1stFlrSF"),
        F.col("qty_r").alias("2ndFlrSF"),
        F.col("n_lines").cast("int").alias("FullBath"),
        (F.col("n_lines") % 3).cast("int").alias("HalfBath"),
        (F.col("last_line") % 2).cast("int").alias("BsmtFullBath"),
        F.col("last_line").cast("int").alias("WoodDeckSF"),
        F.col("top_price").alias("LotArea"),
        F.col("low_price").alias("LotFrontage"),
    )


def kept_sales(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """The columns of the sales view a query needs, written once to the shared
    folder: a fit reads its rows several times and must not repeat the joins."""
    view = sales(spark, sf_dir)
    return materialize(view if columns is None else view.select(*[F.col(f"`{c}`") for c in columns]), "sales")


SALES_SQL = """
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty,
         sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS qty_a,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS qty_n,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r,
         max(l_extendedprice) AS top_price, min(l_extendedprice) AS low_price,
         max(l_linenumber) AS last_line
  FROM lineitem GROUP BY l_orderkey),
sales AS (
  SELECT o_orderkey AS "Id", o_totalprice AS "SalePrice", n_name AS "Neighborhood",
         c_mktsegment AS "BldgType", o_orderpriority AS "Priority",
         CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS "Electrical",
         year(o_orderdate)::INTEGER AS "YrSold",
         CASE WHEN o_orderkey % 11 <> 0 THEN month(o_orderdate)::INTEGER END AS "MoSold",
         (1990 + o_custkey % 12)::INTEGER AS "YearBuilt",
         CASE WHEN o_orderkey % 13 <> 0 THEN (1990 + (o_custkey + o_orderkey) % 12)::INTEGER END AS "YearRemodAdd",
         (1 + o_orderkey % 10)::INTEGER AS "OverallQual", qty AS "GrLivArea", qty_a AS "TotalBsmtSF",
         qty_n AS "1stFlrSF", qty_r AS "2ndFlrSF", n_lines::INTEGER AS "FullBath",
         (n_lines % 3)::INTEGER AS "HalfBath", (last_line % 2)::INTEGER AS "BsmtFullBath",
         last_line::INTEGER AS "WoodDeckSF", top_price AS "LotArea", low_price AS "LotFrontage"
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN lines ON o_orderkey = l_orderkey)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_retailprice").alias("label"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("type"),
        F.concat_ws("_", "p_brand", "p_type").alias("brand_type"),
        (F.col("p_partkey") % 1000).cast("double").alias("x1"),
        F.col("p_size").cast("double").alias("x2"),
    )


PARTS_SQL = """
parts AS (
  SELECT p_partkey AS row_id, p_retailprice AS label,
         CASE WHEN p_size % 7 <> 0 THEN p_size END AS size, p_brand AS brand,
         CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS "type",
         p_brand || '_' || p_type AS brand_type,
         (p_partkey % 1000)::DOUBLE AS x1, p_size::DOUBLE AS x2
  FROM part)"""


def hash_sql(tag: str, key: str) -> str:
    return f"('0x' || substr(md5('{tag}:' || {key}::VARCHAR), 1, 8))::BIGINT"


def split_sql(key: str) -> str:
    return f"CASE WHEN {hash_sql('42', key)} / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END"


def fold_sql(key: str, k: int = 5) -> str:
    return f"({hash_sql('fold:42', key)} % {k})::INTEGER"


def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_split(parts(spark, sf_dir), "row_id")


def folded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_folds(parts(spark, sf_dir), "row_id")
