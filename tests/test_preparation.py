import json

import pytest
from pyspark.sql import functions as F

from tabwright import config
from tabwright.operators import projection as p
from tabwright.operators.domain import DomainFeatures, add_domain_features, bath_columns
from tabwright.operators.split import add_folds, exact_split, hash_split
from tabwright.sources import readers, sinks


def test_alias_is_kept_when_data_name_exists(spark):
    df = spark.createDataFrame([(1, 2, 3)], "FirstFlrSF int, SecondFlrSF int, `2ndFlrSF` int")
    assert p.rename_aliases(df).columns == ["1stFlrSF", "SecondFlrSF", "2ndFlrSF"]


def test_defaults_are_overridden_by_supplied_missing_values(spark):
    df = spark.createDataFrame([(None, 1)], "MoSold int, Id int")
    merged = p.merge_defaults(df, {"MoSold": 2, "YrSold": 2008})
    assert merged.first().asDict() == {"MoSold": None, "Id": 1, "YrSold": 2008}
    assert p.merge_defaults(df, {"MoSold": 2}, fill_nulls=True).first()["MoSold"] == 2


def test_all_record_defaults_are_request_fields():
    assert set(config.RECORD_DEFAULTS) <= set(config.REQUEST_FIELDS)
    assert len(config.RECORD_DEFAULTS) == 59 and len(config.REQUEST_FIELDS) == 79 and len(config.ORDINAL_LEVELS) == 20


def test_schema_errors_mark_rows_and_keep_them(spark):
    df = spark.createDataFrame([("1", "a"), ("1.5", "b"), ("x", "c"), (None, "d")], "LotArea string, Street string")
    out = p.enforce_schema(df, {"LotArea": "int", "Street": "string"}).orderBy("Street").collect()
    assert [r["LotArea"] for r in out] == [1, None, None, None]
    assert [r["error"] for r in out] == [None, "LotArea is not int", "LotArea is not int", None]


def test_first_failing_rule_gives_the_message(spark):
    df = spark.createDataFrame([(None, -1.0), (1, -1.0), (1, 1.0)], "OverallQual int, LotArea double")
    error = p.validation_error(df.columns, required=["OverallQual", "Absent"])
    assert df.select(error).first()[0] == "field 'OverallQual' is required"
    error = p.validation_error(df.columns, required=["OverallQual"])
    assert [r[0] for r in df.select(error).collect()][1:] == ["LotArea must not be negative", None]


def test_batch_limits(spark):
    assert not p.validate_batch(spark.createDataFrame([], "LotArea int"))["valid"]
    many = spark.range(101).select(F.col("id").alias("LotArea"))
    assert p.validate_batch(many)["valid"] and not p.validate_batch(many, 100)["valid"]
    assert p.validate_batch(many)["absent_recommended"] == ["OverallQual", "GrLivArea"]


def test_route_features(spark):
    train = spark.createDataFrame([("a", "Gd", 1, 1.0, None)], "c string, q string, n int, m double, g double")
    test = spark.createDataFrame([("a", "Gd", None, 1.0, 1.0)], "c string, q string, n int, m double, g double")
    only_train = p.route_features(train, train.columns, {"q": ["Gd"]})
    assert only_train == {"categorical": ["c"], "ordinal": ["q"], "numeric_complete": ["n", "m"], "numeric_missing": ["g"]}
    assert p.route_features(train, train.columns, {"q": ["Gd"]}, test)["numeric_missing"] == ["n", "g"]


def test_already_transformed_table_is_left_alone(spark):
    wide = spark.range(3).select(*[F.lit(1.0).alias(f"f{i}") for i in range(101)])
    assert add_domain_features(wide).columns == wide.columns
    assert DomainFeatures().fit(wide).transform(wide).columns == wide.columns


def test_domain_features_by_hand(spark):
    rows = [
        (2000, 2005, 2005, 100.0, 50.0, None, 1, 1, None, 1, 3, "N", None, 5, 10.0, 7.0),
        (2010, 2000, None, None, 50.0, 20.0, 2, 0, 1, 0, None, None, "B", 5, None, 9.0),
    ]
    df = spark.createDataFrame(
        rows,
        "YrSold int, YearBuilt int, YearRemodAdd int, TotalBsmtSF double, FirstFlrSF double, SecondFlrSF double, "
        "FullBath int, HalfBath int, BsmtFullBath int, BsmtHalfBath int, MoSold int, Neighborhood string, BldgType string, "
        "OverallQual int, GrLivArea double, LotArea double",
    )
    a, b = add_domain_features(df).collect()
    assert (a["TotalSF"], b["TotalSF"]) == (150.0, 70.0)
    assert (a["TotalBath"], b["TotalBath"]) == (2.0, 3.0)
    assert (a["HouseAge"], b["HouseAge"]) == (0.0, 10.0)
    assert (a["RemodAge"], b["RemodAge"]) == (0.0, None)
    assert (a["IsRemodeled"], b["IsRemodeled"]) == (0, 1)
    assert (a["Has2ndFlr"], b["Has2ndFlr"]) == (0, 1)
    assert (a["TotalPorchSF"], a["Quality_Area_Interaction"], b["Quality_Area_Interaction"]) == (0.0, 50.0, None)
    assert a["MoSold_sin"] == pytest.approx(1.0) and b["MoSold_cos"] == pytest.approx(-1.0)  # missing month counts as June
    assert (a["Loc_Type"], b["Loc_Type"]) == ("N_nan", "nan_B")
    assert b["LotArea_clip"] == pytest.approx(8.98)


def test_domain_features_of_absent_columns(spark):
    row = add_domain_features(spark.createDataFrame([("x",)], "MoSold string")).first()
    assert (row["TotalSF"], row["TotalBath"], row["HouseAge"], row["Has2ndFlr"], row["Loc_Type"]) == (0.0, 0.0, 0.0, 0, "Unknown_Unknown")
    assert row["MoSold_sin"] is None and row["OverallQual"] == 5 and row["LotArea_clip"] == 0.0


def test_fitted_clip_does_not_move_with_the_frame(spark):
    train = spark.range(1, 101).select(F.col("id").cast("double").alias("LotArea"))
    one = spark.createDataFrame([(1000.0,)], "LotArea double")
    assert DomainFeatures().fit(train).transform(one).first()["LotArea_clip"] == pytest.approx(99.01)
    assert add_domain_features(one).first()["LotArea_clip"] == 1000.0


def test_bath_names():
    assert bath_columns(["Bsmt Full_Bath", "full bath", "HalfBath"]) == [("full bath", 1.0), ("HalfBath", 0.5), ("Bsmt Full_Bath", 1.0)]


def test_split_is_a_partition_and_does_not_depend_on_layout(spark):
    df = spark.range(2000).withColumnRenamed("id", "Id")
    splits = [{r["Id"]: r["split"] for r in hash_split(df.repartition(n), "Id").collect()} for n in (1, 7)]
    assert splits[0] == splits[1] and len(splits[0]) == 2000
    assert 0.17 < sum(v == "test" for v in splits[0].values()) / 2000 < 0.23


@pytest.mark.parametrize("n,share,wanted", [(1001, 0.2, 201), (10, 0.25, 3), (5, 0.0, 0)])
def test_exact_split_size(spark, n, share, wanted):
    out = exact_split(spark.range(n).withColumnRenamed("id", "Id"), "Id", share)
    assert out.filter("split = 'test'").count() == wanted and out.count() == n


def test_folds_cover_all_rows(spark):
    folds = add_folds(spark.range(1000).withColumnRenamed("id", "Id"), "Id").groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4] and sum(r["count"] for r in folds) == 1000


def test_csv_tokens_and_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Id,LotFrontage,PoolQC,n\n1,60.5,NA,3\n2,NA,Gd,\n3,,None,4\n")
    df = readers.read_training_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"Id": "bigint", "LotFrontage": "double", "PoolQC": "string", "n": "bigint"}
    assert [tuple(r) for r in df.orderBy("Id").collect()] == [(1, 60.5, None, 3), (2, None, "Gd", None), (3, None, None, 4)]
    kept = readers.read_training_csv(spark, str(tmp_path / "t.csv"), na_tokens=[""]).orderBy("Id")
    assert [r["PoolQC"] for r in kept.collect()] == ["NA", "Gd", "None"]


def test_json_batch_isolates_bad_records(spark, tmp_path):
    body = {"houses": [{"LotArea": 100, "Street": "Pave"}, {"LotArea": "wide"}, {"Unknown": 1}]}
    (tmp_path / "b.json").write_text(json.dumps(body, indent=1))
    rows = readers.read_json_batches(spark, str(tmp_path / "b.json")).orderBy("position").collect()
    assert [r["LotArea"] for r in rows] == [100, None, None]
    assert [r["error"] for r in rows] == [None, "LotArea is not int", None]


def test_cache_computes_once(spark, tmp_path):
    cache, calls = sinks.ResultCache(spark, str(tmp_path / "cache")), []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert cache.load("k") == (None, None)
    for _ in range(2):
        assert cache.read_or_compute("k", compute, {"a": 1}).count() == 3
    assert len(calls) == 1 and cache.load("k")[1]["a"] == 1


def test_cache_follows_its_input(spark, tmp_path):
    cache, calls, path = sinks.ResultCache(spark, str(tmp_path / "cache")), [], str(tmp_path / "a b [1]")

    def total(where="id >= 0"):
        rows = spark.read.schema("id bigint").parquet(path.replace("[", "\\[").replace("]", "\\]")).filter(where)

        def compute():
            calls.append(1)
            return rows.groupBy().count()

        return cache.read_or_compute("k", compute, source=rows).first()[0]

    spark.range(3).write.parquet(path)
    assert (total(), total(), len(calls)) == (3, 3, 1)
    spark.range(2).write.mode("append").parquet(path)
    assert (total(), total(), len(calls)) == (5, 5, 2)
    spark.range(10, 14).write.mode("overwrite").parquet(path)
    assert (total(), total(), len(calls)) == (4, 4, 3)
    assert (total("id > 11"), total("id > 11"), len(calls)) == (2, 2, 4)


def test_source_key_of_rows_in_the_plan(spark):
    one, other = (spark.sql(f"SELECT * FROM VALUES (1), ({n}) AS t(a)") for n in (2, 3))
    again = spark.sql("SELECT * FROM VALUES (1), (2) AS t(a)")
    assert sinks.source_key(one) == sinks.source_key(again) != sinks.source_key(other)
    assert sinks.source_key(spark.range(3)) != sinks.source_key(spark.range(4))


def test_run_log_keeps_the_parent(spark, tmp_path):
    log = sinks.RunLog(spark, str(tmp_path / "log"), "outer")
    child = log.child("inner")
    child.metrics(rmse=1.5)
    row = sinks.RunLog.read(spark, str(tmp_path / "log")).first()
    assert (row["parent_id"], row["run_name"], row["key"], row["value"]) == (log.run_id, "inner", "rmse", "1.5")


def test_numbers_in_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Id,code,n,x\n1,1F,7,1e3\n2,2D,-8,.5\n3,5d,9,NA\n")
    df = readers.read_training_csv(spark, str(tmp_path / "t.csv")).orderBy("Id")
    assert dict(df.dtypes) == {"Id": "bigint", "code": "string", "n": "bigint", "x": "double"}
    assert [r["code"] for r in df.collect()] == ["1F", "2D", "5d"]
    checked = p.enforce_schema(spark.createDataFrame([("5d",), ("-2147483648",), ("2147483648",)], "LotArea string"), {"LotArea": "int"}).collect()
    assert [r["LotArea"] for r in checked] == [None, -2147483648, None] and [bool(r["error"]) for r in checked] == [True, False, True]


def test_rows_are_numbered_in_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n" + "".join(f"{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.with_position(spark.read.option("header", True).csv(str(tmp_path / "t.csv"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(int(r["a"]) == r["position"] for r in rows) and len(rows) == 5000


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    from tabwright.streaming.score_stream import write_scores

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for start in (0, 5):
        spark.range(start, start + 5).write.mode("append").parquet(source)
        write_scores(spark.readStream.schema("id bigint").parquet(source), sink).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(10))
