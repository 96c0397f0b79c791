"""Readers with explicit rules for missing values and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tabwright import config
from tabwright.functions.nulls import col, nan_columns_to_null, text_to_double, tokens_to_null
from tabwright.operators.projection import enforce_schema
from tabwright.sources.json_lists import read_list_records


WHOLE = r"^\s*[+-]?\d+\s*$"


def request_schema(fields: dict[str, str] | None = None) -> T.StructType:
    kinds = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(c, kinds[k], True) for c, k in (fields or config.REQUEST_FIELDS).items()])


def read_text_table(spark: SparkSession, path: str, na_tokens=config.NA_TOKENS) -> DataFrame:
    """CSV with a header; every column as text, NA tokens as NULL.  Column
    names come from the header only, so no pass over the data is needed."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[tokens_to_null(col(c), na_tokens).alias(c) for c in raw.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """Narrowest of bigint, double and string that holds every value: one pass."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return {}
    bad = lambda c, value: F.count_if(col(c).isNotNull() & value.isNull())
    whole = [bad(c, F.when(col(c).rlike(WHOLE), col(c).try_cast("bigint"))) for c in names]
    row = df.agg(*whole, *[bad(c, text_to_double(col(c))) for c in names], *[F.count(col(c)) for c in names]).first()
    n = len(names)
    out = {}
    for i, c in enumerate(names):
        if row[2 * n + i] == 0:
            out[c] = "double"  # an empty column reads as numeric
        else:
            out[c] = "bigint" if row[i] == 0 else "double" if row[n + i] == 0 else "string"
    return out


def read_training_csv(spark: SparkSession, path: str, fields: dict[str, str] | None = None, na_tokens=config.NA_TOKENS) -> DataFrame:
    """Training table.  Known fields get their declared type; with no
    declaration the types are inferred from all rows."""
    text = read_text_table(spark, path, na_tokens)
    types = infer_types(text) if fields is None else {c: k for c, k in fields.items() if c in text.columns}
    rest = infer_types(text.select(*[col(c) for c in text.columns if c not in types])) if fields is not None else {}
    types = {**types, **rest}
    return text.select(*[typed(c, types.get(c, "string")).alias(c) for c in text.columns])


def typed(name: str, kind: str) -> Column:
    """A text column as ``kind``; text that is no number of that kind becomes NULL."""
    if kind == "string":
        return col(name)
    return F.when(text_to_double(col(name)).isNotNull(), col(name).try_cast(kind))


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a file table from 0 in the order of its splits.  Rows are counted by split first; the table of splits is
    small, and no row moves."""
    row = free_name(df, "_row")
    placed = df.withColumn(row, F.monotonically_increasing_id())
    split, place = F.shiftright(row, 33), col(row).bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(split.alias("_split")).agg(F.count(F.lit(1)).alias("_rows"))
    first = F.coalesce(F.sum("_rows").over(Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_split", first.alias("_first"))
    return placed.join(starts, split == F.col("_split")).withColumn(name, place + F.col("_first")).drop(row, "_split", "_first")


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def read_batch_csv(spark: SparkSession, path: str, fields: dict[str, str] | None = None, na_tokens=config.NA_TOKENS) -> DataFrame:
    """Batch to score: any subset of the known fields under either spelling;
    a value of the wrong type is reported in ``error``."""
    text = read_text_table(spark, path, na_tokens)
    return enforce_schema(text, fields or {**config.REQUEST_FIELDS, **config.data_schema_fields()})


def read_json_batches(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """Files of ``{"houses": [record, ...]}``: one row per record, with the
    file and the position it came from."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.input_file_name().alias("source"))
    return explode_batches(text, "body", fields, keep=("source",))


def read_large_json_batches(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """``read_json_batches`` for files of any size: the records of one file come from many tasks (see ``json_lists``)."""
    fields = fields or config.REQUEST_FIELDS
    record = T.StructType([T.StructField(c, T.StringType(), True) for c in fields])
    found = read_list_records(spark, path).select("source", "position", F.from_json("value", record).alias("record"), F.col("error").alias("_refused"))
    typed = enforce_schema(found.select("source", "position", "record.*", "_refused"), fields)
    return typed.withColumn("error", F.coalesce("_refused", "error")).drop("_refused")


def explode_batches(df: DataFrame, body: str, fields: dict[str, str] | None = None, keep=()) -> DataFrame:
    """Parse a JSON batch column.  Fields are read as text first, so one value
    of the wrong type spoils its record only and not the whole batch."""
    fields = fields or config.REQUEST_FIELDS
    record = T.StructType([T.StructField(c, T.StringType(), True) for c in fields])
    batch = T.StructType([T.StructField("houses", T.ArrayType(record), True)])
    rows = df.select(
        *[col(c) for c in keep], F.posexplode(F.from_json(col(body), batch)["houses"]).alias("position", "record")
    ).select(*[col(c) for c in keep], "position", "record.*")
    return enforce_schema(rows, fields)


def spoiled_batches(df: DataFrame, body: str, keep=()) -> DataFrame:
    """The bodies from which no record can be read, each with the reason in ``error``."""
    records = F.from_json(col(body), "houses array<string>")["houses"]
    reason = F.when(records.isNull(), "the body has no list of houses").when(F.size(records) == 0, "the list of houses is empty")
    return df.select(*[col(c) for c in keep], reason.alias("error")).filter("error IS NOT NULL")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return nan_columns_to_null(spark.read.parquet(path))
