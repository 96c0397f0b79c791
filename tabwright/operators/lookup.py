"""Level tables: counts per level, and lookup of a fitted value by level.

A table is applied by its checked size: literals up to ``LITERAL_LEVELS``, a
broadcast join up to ``BROADCAST_BYTES`` and a salted shuffle join above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabwright.functions.nulls import col, text_or_nan
from tabwright.session import materialize

LITERAL_LEVELS = 256
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64  # a row without its text: value, hash entry and pointers
HOT_SHARE = 0.005  # at most 200 levels can hold this share
SALTS = 64


def long_levels(df: DataFrame, cols, keep_null: bool = False) -> DataFrame:
    """(column, level) with one row per cell, as text."""
    wide = df.select(*[(col(c).cast("string") if keep_null else text_or_nan(col(c))).alias(c) for c in cols])
    return wide.unpivot([], [f"`{c}`" for c in cols], "column", "level")


def level_counts(df: DataFrame, cols, keep_null: bool = False) -> DataFrame:
    """Value counts of all columns in one job.  The count is combined before
    the shuffle, so a level that holds most rows costs no more than others."""
    return long_levels(df, cols, keep_null).groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


class LevelTable:
    """(column, level, n, value) with one row per fitted level."""

    SCHEMA = "column string, level string, n bigint, value double"

    def __init__(self, frame: DataFrame, columns):
        self.columns = list(columns)
        self.frame = frame
        self.literals: dict[str, dict[str, float]] = {}
        self.counts: dict[str, dict[str, int]] = {}
        self.sizes: dict[str, int] = {}
        self.bytes: dict[str, int] = {}
        self.hot: dict[str, list[str]] = {}
        self._split(frame)

    def _split(self, frame: DataFrame) -> None:
        spark = frame.sparkSession
        bound = LITERAL_LEVELS * max(len(self.columns), 1)
        rows = frame.limit(bound + 1).collect()
        if len(rows) <= bound:
            self.frame = spark.createDataFrame(rows, self.SCHEMA)
        else:
            self.frame = materialize(frame, "levels")
            rows = None
        if rows is not None:
            grouped: dict[str, list] = {c: [] for c in self.columns}
            for r in rows:
                grouped[r["column"]].append(r)
            self.sizes = {c: len(v) for c, v in grouped.items()}
            self.bytes = {c: sum(ROW_BYTES + 2 * len(r["level"]) for r in v) for c, v in grouped.items()}
            totals = {c: sum(r["n"] for r in v) for c, v in grouped.items()}
            hot = [r for v in grouped.values() for r in v if r["n"] >= HOT_SHARE * totals[r["column"]]]
        else:
            stats = self.frame.groupBy("column").agg(
                F.count(F.lit(1)).alias("size"),
                F.sum("n").alias("total"),
                F.sum(F.octet_length("level") + ROW_BYTES).alias("bytes"),
            ).collect()
            self.bytes = {c: 0 for c in self.columns} | {r["column"]: r["bytes"] for r in stats}
            self.sizes = {c: 0 for c in self.columns} | {r["column"]: r["size"] for r in stats}
            is_hot = F.lit(False)
            for r in stats:
                is_hot |= (F.col("column") == r["column"]) & (F.col("n") >= HOT_SHARE * r["total"])
            hot = self.frame.filter(is_hot).collect()
            small = [c for c, size in self.sizes.items() if size <= LITERAL_LEVELS]
            rows = self.frame.filter(F.col("column").isin(small)).collect() if small else []
        for r in hot:
            self.hot.setdefault(r["column"], []).append(r["level"])
        self.literals = {c: {} for c, size in self.sizes.items() if size <= LITERAL_LEVELS}
        self.counts = {c: {} for c in self.literals}
        for r in sorted(rows, key=lambda r: -r["n"]):  # a literal search meets frequent levels first
            if r["column"] in self.literals:
                self.literals[r["column"]][r["level"]] = r["value"]
                self.counts[r["column"]][r["level"]] = r["n"]

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns) -> "LevelTable":
        return cls(spark.read.schema(cls.SCHEMA).parquet(path), columns)

    def save(self, path: str) -> None:
        self.frame.write.mode("overwrite").parquet(path)

    def levels_of(self, column: str) -> DataFrame:
        return self.frame.filter(F.col("column") == column).select("level", "n", "value")

    def join_value(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Left join of the level table of ``column``; the miss is NULL."""
        table = self.levels_of(column).select(F.col("level").alias("_level"), F.col("value").alias(out))
        key = text_or_nan(col(column))
        if self.bytes[column] <= BROADCAST_BYTES:
            return df.join(F.broadcast(table), key == F.col("_level"), "left").drop("_level")
        # Rows of hot levels spread over SALTS tasks; only those levels are copied.
        # A missing key is one of them: it need not be frequent at the fit to be so now.
        hot = sorted({*self.hot.get(column, []), "nan"})
        salted = table.withColumn(
            "_salt",
            F.explode(F.when(F.col("_level").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))),
        )
        hashed = [col(f.name) for f in df.schema if isinstance(f.dataType, T.AtomicType)]  # maps have no hash
        spread = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")
        left = df.withColumn("_row_salt", F.when(key.isin(hot), spread).otherwise(F.lit(0)))
        return left.join(
            salted, (key == F.col("_level")) & (F.col("_row_salt") == F.col("_salt")), "left"
        ).drop("_level", "_salt", "_row_salt")

    def literal_value(self, column: str, c: Column) -> Column:
        mapping = self.literals[column]
        if not mapping:
            return F.lit(None).cast("double")
        return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[c]


def map_levels(c: Column, mapping: dict) -> Column:
    """Lookup with NULL on a miss for a small fixed mapping."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[c]


def most_frequent(df: DataFrame, cols) -> dict[str, str | None]:
    """Mode per column, the smallest value on a tie, without a per-group buffer
    of all levels: levels are counted first and only the winner is kept."""
    if not cols:
        return {}
    out: dict[str, str | None] = {c: None for c in cols}
    # Columns of one type compare in their own order (9 before 10 for numbers).
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for names in by_type.values():
        counts = (
            df.select(*[col(c) for c in names])
            .unpivot([], [f"`{c}`" for c in names], "column", "level")
            .filter(F.col("level").isNotNull())
            .groupBy("column", "level")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        best = counts.groupBy("column").agg(F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("level"))
        out.update({r["column"]: r["level"] for r in best.collect()})
    return out
