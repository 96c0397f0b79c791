"""Hash values that depend on the row id and a seed only, so a split or a fold
is the same under any partitioning and can be recomputed in other engines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def seeded_hash(row_id: Column, seed) -> Column:
    """First 32 bits of md5('<seed>:<id>') as a bigint."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_hash(row_id: Column, seed) -> Column:
    return seeded_hash(row_id, seed) / F.lit(float(HASH_RANGE))


def fold_hash(row_id: Column, k: int, seed) -> Column:
    # A tag keeps folds independent of the train/test split made with this seed.
    return (seeded_hash(row_id, f"fold:{seed}") % F.lit(k)).cast("int")
