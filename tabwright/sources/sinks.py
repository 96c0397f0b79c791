"""Sinks, result cache, run log and model card."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright import config


def write_csv(df: DataFrame, path: str) -> None:
    """One file per partition, each with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def input_state(spark: SparkSession, files: list[str]) -> str:
    """Digest of the paths, sizes and times of files.  Only the listing is read, by Spark's own file source, and combined there."""
    if not files:
        return "none"
    literal = [re.sub(r"([\\[\]{}*?\\\\])", r"\\\1", unquote(f)) for f in files]
    listed = spark.read.format("binaryFile").load(literal).select("path", "length", "modificationTime")
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    row = listed.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(one), F.sum(F.shiftright(one, 16))).first()
    return "-".join(str(v) for v in row)


def source_key(df: DataFrame) -> str:
    """What a table was made from: the text of its plan, and its input files with size and time.

    Numbers of expressions count from 0 in each plan, so a later session finds the same key.  Rows that stand in the plan itself (made
    from Python) count by the plan's hash.  A Python function counts by its name: a changed body is not seen.  The files are those listed
    when ``df`` was made; read the folder again to see new ones."""
    spark = df.sparkSession
    wide = "spark.sql.debug.maxToStringFields", "spark.sql.maxPlanStringLength"
    before = {key: spark.conf.get(key, None) for key in wide}
    try:
        for key in wide:
            spark.conf.set(key, str(2**31 - 1 - 16))
        plan = df._jdf.queryExecution().analyzed()
        text = plan.toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    places: dict[str, int] = {}
    text = re.sub(r"#(\d+)", lambda m: f"#{places.setdefault(m.group(1), len(places))}", text)
    files = sorted(df.inputFiles())
    inside = "" if files and "LocalRelation" not in text and "LogicalRDD" not in text else str(df.semanticHash())
    return hashlib.sha256("\n".join((text, inside, input_state(spark, files))).encode()).hexdigest()


class ResultCache:
    """Tables by key under one folder, each with a metadata row."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _row(self, key: str):
        try:
            return self.spark.read.parquet(f"{self.root}/{key}/metadata").first()
        except AnalysisException:  # no such folder, or nothing in it yet
            return None

    def exists(self, key: str) -> bool:
        return self._row(key) is not None

    def save(self, df: DataFrame, key: str, metadata: dict | None = None) -> None:
        """Each save writes a folder of its own; the metadata, written last, names the one that counts."""
        version = uuid.uuid4().hex
        write_table(df, f"{self.root}/{key}/table-{version}")
        row = self.spark.createDataFrame([(key, json.dumps(metadata or {}), version)], "cache_key string, metadata string, version string")
        write_table(row.withColumn("created_at", F.current_timestamp()), f"{self.root}/{key}/metadata")

    def load(self, key: str) -> tuple[DataFrame | None, dict | None]:
        row = self._row(key)
        if row is None:
            return None, None
        meta = {**json.loads(row["metadata"]), "cache_key": key, "created_at": row["created_at"]}
        return self.spark.read.parquet(f"{self.root}/{key}/table-{row['version']}"), meta

    def read_or_compute(self, key: str, compute, metadata: dict | None = None, source: DataFrame | None = None) -> DataFrame:
        """The table of ``key``, computed if there is none or if it was saved for other metadata, or from another state of ``source``
        (see ``source_key``)."""
        wanted = dict(metadata or {}) if source is None else {**(metadata or {}), "source_key": source_key(source)}
        row = self._row(key)
        if row is None or json.loads(row["metadata"]) != json.loads(json.dumps(wanted)):
            self.save(compute(), key, wanted)
        return self.load(key)[0]


class RunLog:
    """Parameters and metrics of nested runs, appended to one long table."""

    SCHEMA = "run_id string, parent_id string, run_name string, kind string, key string, value string"

    def __init__(self, spark: SparkSession, path: str | None, run_name: str, parent_id: str | None = None):
        self.spark, self.path, self.run_name, self.parent_id = spark, path, run_name, parent_id
        self.run_id = uuid.uuid4().hex

    def child(self, run_name: str) -> "RunLog":
        return RunLog(self.spark, self.path, run_name, self.run_id)

    def _append(self, kind: str, values: dict) -> None:
        if self.path is None or not values:
            return
        rows = [(self.run_id, self.parent_id, self.run_name, kind, k, None if v is None else str(v)) for k, v in values.items()]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def params(self, **values) -> None:
        self._append("param", values)

    def metrics(self, **values) -> None:
        self._append("metric", values)

    @staticmethod
    def read(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(RunLog.SCHEMA).parquet(path)


def model_card(
    spark: SparkSession, name: str, performance: dict, hyperparameters: dict, table: config.TableConfig, domain_columns=()
) -> DataFrame:
    """One row of nested structs: model, performance, parameters, features."""
    body = {
        "model_info": {"name": name, "type": "Single", "model_version": "1.0"},
        "performance": {k: None if v is None else float(v) for k, v in performance.items()},
        "hyperparameters": {k: None if v is None else str(v) for k, v in hyperparameters.items()},
        "feature_engineering": {
            "domain_features": list(domain_columns),
            "target_encoder_features": list(table.target_encoded),
            "target_encoder_alpha": table.smoothing,
            "rare_pooler_min_count": table.rare_min_count,
            "quantile_transformer_n_quantiles": table.n_quantiles,
            "imputation_strategy_categorical": "most_frequent",
            "imputation_strategy_numerical": "median",
        },
        "preprocessing": {
            "ordinal_features": list(table.ordinal_levels),
            "missingness_indicator_auto": True,
            "one_hot_encoder_handle_unknown": "ignore",
        },
    }
    text = json.dumps(body)
    schema = F.schema_of_json(F.lit(text))
    card = spark.range(1).select(F.from_json(F.lit(text), schema).alias("card")).select("card.*")
    return card.withColumn("model_info", F.col("model_info").withField("timestamp", F.current_timestamp().cast("string")))


def write_model_card(card: DataFrame, path: str) -> None:
    card.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    yaml = card.select(F.explode(F.array(*[F.concat(F.lit(f"{c}: "), F.to_json(F.col(c))) for c in card.columns])).alias("value"))
    # JSON values are valid YAML flow values, so one "section: value" line each.
    yaml.coalesce(1).write.mode("overwrite").text(f"{path}/yaml")
