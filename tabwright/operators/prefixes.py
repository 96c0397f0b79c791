"""Errors of all prefixes of an ensemble: its first 1, 2, ..., n trees, from one fit and one pass over the rows.

A boosted ensemble of fewer trees, fitted with the same seed, is a prefix of the larger one.  The first trees of a forest are a forest
of that size (not the one that a fit of that size draws).  Each row gets the leaf it reaches in every tree from the model itself; the
outputs of the leaves, eight bytes each, go to the tasks in blocks of whole trees, and between two blocks the rows keep the sum of
the outputs so far.  A task adds up errors by number of trees, so the rows shuffled are tasks x trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, functions as F

from tabwright.operators.explain import node_table
from tabwright.functions.nulls import col
from tabwright.session import materialize

#: Bytes of leaf outputs that are sent to the tasks at once.
BLOCK_BYTES = 32 << 20
#: Cells (rows x trees) that a task holds at once.
CELLS = 1 << 20
SUMS = "n_estimators int, n bigint, squares double, absolutes double, y double, yy double"


def blocks_of_trees(leaves: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """First and last tree of each block."""
    blocks, filled = [], 0
    for tree, n in leaves.groupBy("tree").count().orderBy("tree").collect():  # a row a tree
        if not blocks or filled + 8 * n > block_bytes:
            blocks.append([tree, tree])
            filled = 0
        blocks[-1][1] = tree
        filled += 8 * n
    return [(a, b) for a, b in blocks]


def prefix_scores(model, rows: DataFrame, label: str = "label", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each number of trees: n_estimators, rmse, mae and r2 on ``rows``."""
    spark, boosted = rows.sparkSession, isinstance(model, GBTRegressionModel)
    nodes = node_table(model)
    weight = F.col("weight") if boosted else F.lit(1.0)
    leaves = materialize(nodes.filter("left < 0").select("tree", "id", (weight * F.col("prediction")).alias("output")), "leaves")
    middle = rows.agg(F.avg(col(label))).first()[0] or 0.0
    before = model.getLeafCol()
    try:
        reached = model.setLeafCol("_leaf").transform(rows).select(col(label).cast("double").alias("label"), vector_to_array("_leaf").alias("leaf"))
    finally:
        model.setLeafCol(before)
    state = reached.withColumn("sum", F.lit(0.0))
    blocks, found = blocks_of_trees(leaves, block_bytes), None
    if len(blocks) > 1:
        state = materialize(state, "reached")
    for first, last in blocks:
        part = leaves.filter(F.col("tree").between(first, last)).orderBy("tree", "id").toPandas()
        # Leaves of a tree count from the left, which is the order of their nodes.
        starts = np.flatnonzero(np.diff(part["tree"].to_numpy(), prepend=-1))
        shared = spark.sparkContext.broadcast((part["output"].to_numpy(), starts))
        outputs = adder(shared, first, last)
        sums = state.mapInPandas(errors(outputs, first, middle, boosted), SUMS).groupBy("n_estimators").agg(*[F.sum(c.split()[0]).alias(c.split()[0]) for c in SUMS.split(", ")[1:]])
        sums = materialize(sums, "errors") if len(blocks) > 1 else sums
        found = sums if found is None else found.unionByName(sums)
        if last != blocks[-1][1]:
            state = materialize(state.mapInPandas(carried(outputs), state.schema), "reached")
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    return found.select(
        "n_estimators",
        F.sqrt(F.col("squares") / F.col("n")).alias("rmse"),
        (F.col("absolutes") / F.col("n")).alias("mae"),
        F.when(spread > 0, 1 - F.col("squares") / spread).otherwise((F.col("squares") == 0).cast("double")).alias("r2"),
    )


def adder(shared, first: int, last: int):
    def outputs(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Slices of the rows with the running sums of their outputs over the trees of the block."""
        values, starts = shared.value
        step = max(1, CELLS // (last - first + 1))
        for at in range(0, len(frame), step):
            some = frame.iloc[at : at + step]
            leaf = np.stack([x[first : last + 1] for x in some["leaf"]]).astype(np.int64)
            yield some, some["sum"].to_numpy()[:, None] + np.cumsum(values[starts + leaf], axis=1)

    return outputs


def errors(outputs, first: int, middle: float, boosted: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squares, absolutes, n, y, yy = 0.0, 0.0, 0, 0.0, 0.0
        for frame in frames:
            for some, sums in outputs(frame[frame["label"].notna()]):
                trees = first + 1 + np.arange(sums.shape[1])
                label = some["label"].to_numpy()
                off = label[:, None] - (sums if boosted else sums / trees)
                squares, absolutes = squares + (off * off).sum(axis=0), absolutes + np.abs(off).sum(axis=0)
                n, y, yy = n + len(some), y + (label - middle).sum(), yy + ((label - middle) ** 2).sum()
        if n:
            yield pd.DataFrame({"n_estimators": trees, "n": n, "squares": squares, "absolutes": absolutes, "y": y, "yy": yy})

    return run


def carried(outputs):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for some, sums in outputs(frame):
                yield some.assign(sum=sums[:, -1])

    return run
