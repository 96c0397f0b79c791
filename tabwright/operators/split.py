"""Train/test split and folds from a hash of the row id."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tabwright import config
from tabwright.functions.hashing import fold_hash, seeded_hash, unit_hash
from tabwright.functions.nulls import col


def hash_split(
    df: DataFrame, row_id: str, test_size: float = config.TEST_SIZE, seed: int = config.SEED, split: str = "split"
) -> DataFrame:
    """Add ``split`` = 'train' or 'test'; sizes agree in expectation."""
    return df.withColumn(split, F.when(unit_hash(col(row_id), seed) < test_size, "test").otherwise("train"))


def exact_split(
    df: DataFrame, row_id: str, test_size: float = config.TEST_SIZE, seed: int = config.SEED, split: str = "split"
) -> DataFrame:
    """Exactly ceil(test_size * rows) test rows: those with the smallest
    (hash, id).  The cut is found by counting hash buckets twice, so only the
    rows of one small bucket are ever sorted."""
    h = seeded_hash(col(row_id), seed)
    keys = df.select(h.alias("h"), col(row_id).alias("id"))
    # Bits 20..31, then bits 8..19 of the hash, then the rows that are left.
    total, wanted, prefix = None, None, []
    for shift in (20, 8):
        inside = keys
        for s, b in prefix:
            inside = inside.filter(F.shiftrightunsigned("h", s) % 4096 == b)
        buckets = sorted(
            (r["b"], r["n"])
            for r in inside.groupBy((F.shiftrightunsigned("h", shift) % 4096).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        )
        if total is None:
            total = sum(n for _, n in buckets)
            wanted = math.ceil(test_size * total)
            if wanted <= 0 or wanted >= total:
                return df.withColumn(split, F.lit("test" if wanted and total else "train"))
        for b, n in buckets:
            if wanted <= n:
                prefix.append((shift, b))
                break
            wanted -= n
    last = keys
    for s, b in prefix:
        last = last.filter(F.shiftrightunsigned("h", s) % 4096 == b)
    cut = last.orderBy("h", "id").limit(wanted).orderBy(F.desc("h"), F.desc("id")).first()
    test = (h < cut["h"]) | ((h == cut["h"]) & (col(row_id) <= F.lit(cut["id"])))
    return df.withColumn(split, F.when(test, "test").otherwise("train"))


def add_folds(
    df: DataFrame, row_id: str, k: int = config.CV_FOLDS, seed: int = config.SEED, fold: str = "fold"
) -> DataFrame:
    return df.withColumn(fold, fold_hash(col(row_id), k, seed))
