"""Additive explanations: exact Shapley values of tree ensembles and linear
models, top contributions per row, waterfall and importance tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabwright import config
from tabwright.functions.hashing import seeded_hash
from tabwright.functions.nulls import col
from tabwright.functions.scalars import contribution_type
from tabwright.operators.ranks import row_index
from tabwright.session import materialize, scratch_path

LEAVES_PER_STEP = 256
#: Bytes of the leaf arrays that are sent to the workers at once.
BLOCK_BYTES = 32 << 20


# --- tree ensembles -------------------------------------------------------------


def node_table(model) -> DataFrame:
    """Nodes of a fitted ensemble as a table: (tree, weight, id, prediction,
    cover, left, right, feature, threshold or left categories)."""
    spark = SparkSession.active()
    path = scratch_path(spark, "ensemble")
    model.write().overwrite().save(path)
    weights = list(model.treeWeights)
    total = 1.0 if isinstance(model, GBTRegressionModel) else float(len(weights))
    weight = F.get(F.lit([float(w) / total for w in weights]), F.col("treeID"))
    n = "nodeData"
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        weight.alias("weight"),
        F.col(f"{n}.id").alias("id"),
        F.col(f"{n}.prediction").alias("prediction"),
        F.col(f"{n}.rawCount").cast("double").alias("cover"),
        F.col(f"{n}.leftChild").alias("left"),
        F.col(f"{n}.rightChild").alias("right"),
        F.col(f"{n}.split.featureIndex").alias("feature"),
        F.col(f"{n}.split.leftCategoriesOrThreshold").alias("split"),
        F.col(f"{n}.split.numCategories").alias("categories"),
    )


LEAVES = "tree int, id int, value double, share double, features array<int>, low array<double>, high array<double>, cover array<double>"


def leaf_paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves of trees whose nodes come one after the other, each before its children.  Held are the paths to the children of the nodes
    seen that have not come yet: at most one a level."""
    columns = [field.split()[0] for field in LEAVES.split(", ")]
    waiting: dict[tuple[int, int], tuple] = {}
    for frame in frames:
        found = []
        for tree, weight, id_, prediction, cover, left, right, feature, threshold in frame.itertuples(index=False):
            path, share, last, whole = waiting.pop((tree, id_), ({}, 1.0, None, cover))
            part = cover / whole if whole else 0.0
            if last is not None:
                low, high, z = path[last]
                path[last] = (low, high, z * part)
            if left < 0:
                features = sorted(path)
                found.append((tree, id_, weight * prediction, share * part, features, *([path[f][k] for f in features] for k in range(3))))
                continue
            low, high, z = path.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
                waiting[tree, child] = {**path, feature: (*bounds, z)}, share * part, feature, cover
        yield pd.DataFrame(found, columns=columns)


def leaf_table(nodes: DataFrame) -> DataFrame:
    """One row per leaf: its weighted value and, per distinct feature on the way to it, the interval that leads there and the share of
    rows that take it; and the block it is explained in.

    A fitted ensemble numbers the nodes of a tree in the order of a walk that takes the left side first.  In that order one pass over a tree makes
    the paths and holds one entry a level; trees go to different tasks, and no node goes to the driver."""
    nodes = materialize(nodes, "nodes")
    categorical, unordered = (F.count_if(F.expr(f"left >= 0 AND {x}")) for x in ("categories >= 0", "(left <= id OR right <= left)"))
    wrong = nodes.agg(categorical, unordered).first()
    if wrong[0]:
        raise ValueError("categorical splits are not supported: encode categories before the trees")
    if wrong[1]:
        raise ValueError("the nodes of a tree must be numbered with the left side first")
    ordered = nodes.repartition("tree").sortWithinPartitions("tree", "id")
    threshold = F.get("split", F.lit(0)).alias("threshold")
    walked = ordered.select("tree", "weight", "id", "prediction", "cover", "left", "right", "feature", threshold).mapInPandas(leaf_paths, LEAVES)
    return in_blocks(materialize(walked, "leaves")).drop("id")


def in_blocks(leaves: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``leaves`` with ``block``: as many leaves each as fill ``block_bytes`` when all paths are as long as the longest."""
    count, depth = leaves.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    each = max(1, block_bytes // (8 + 32 * max(depth or 0, 1)))
    if count <= each:
        return leaves.withColumn("block", F.lit(0).cast("long"))
    numbered = row_index(leaves, ["tree", "id"], "block")
    return numbered.withColumn("block", F.floor(F.col("block") / each))


def base_value(leaves: DataFrame) -> float:
    """Expected output of the model: leaf values weighted by their share."""
    return leaves.agg(F.sum(F.col("value") * F.col("share"))).first()[0]


def _padded(leaves: DataFrame):
    """Leaf table as arrays; shorter paths are filled with neutral entries."""
    pdf = leaves.toPandas()
    depth = max([len(f) for f in pdf["features"]], default=0) or 1

    def fill(column, neutral, kind=float):
        out = np.full((len(pdf), depth), neutral, dtype=kind)
        for i, v in enumerate(pdf[column]):
            out[i, : len(v)] = v
        return out

    return dict(
        value=pdf["value"].to_numpy(float),
        feature=fill("features", 0, int),
        low=fill("low", -np.inf),
        high=fill("high", np.inf),
        cover=fill("cover", 1.0),
    )


def shapley_of_batch(x: np.ndarray, leaves: dict) -> np.ndarray:
    """Path-dependent Shapley values of a batch of rows.

    For one leaf with d features, the Shapley weight of a subset of size k is
    the integral of t^k (1-t)^(d-1-k) over [0, 1].  Summed over all subsets this
    gives, for feature j, value * (o_j - z_j) * integral of the product over
    i != j of (z_i (1-t) + o_i t), where z_i is the share of rows that follow
    the path at feature i and o_i tells whether this row does.  The integrand
    is a polynomial of degree below d, so Gauss-Legendre nodes give it exactly."""
    depth = leaves["feature"].shape[1]
    nodes, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
    nodes, weights = (nodes + 1) / 2, weights / 2
    out = np.zeros_like(x)
    for start in range(0, len(leaves["value"]), LEAVES_PER_STEP):
        part = {k: v[start : start + LEAVES_PER_STEP] for k, v in leaves.items()}
        at = x[:, part["feature"]]
        follows = ((at > part["low"]) & (at <= part["high"])).astype(float)
        z = part["cover"][None]
        total = np.zeros_like(at)
        for t, w in zip(nodes, weights):
            factor = np.maximum(z * (1 - t) + follows * t, 1e-300)
            total += w * factor.prod(axis=2, keepdims=True) / factor
        phi = part["value"][None, :, None] * (follows - z) * total
        flat = part["feature"].ravel()
        order = np.argsort(flat, kind="stable")
        touched, starts = np.unique(flat[order], return_index=True)
        out[:, touched] += np.add.reduceat(phi.reshape(len(x), -1)[:, order], starts, axis=1)
    return out


def block_contributions(features: str, leaves: DataFrame) -> Column:
    """Contributions of the leaves of one block, whose arrays are broadcast."""
    arrays = leaves.sparkSession.sparkContext.broadcast(_padded(leaves))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def values(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        phi = np.concatenate(
            [shapley_of_batch(np.stack(vectors.iloc[i : i + 512].to_numpy()), arrays.value) for i in range(0, len(vectors), 512)]
        )
        return pd.Series(list(phi))

    return values(vector_to_array(col(features)))


def tree_shap(df: DataFrame, leaves: DataFrame, features: str = "features", out: str = "shap") -> DataFrame:
    """Add ``out``: array of one contribution per feature.  Rows are explained in Arrow batches where they are, block of leaves by block
    of leaves; the contributions of the blocks are added up element by element.  A model of more than one block has its rows
    written between the blocks, so one block at a time, of at most ``BLOCK_BYTES``, is in the memory of the driver and the workers."""
    blocks = [r["block"] for r in leaves.select("block").distinct().orderBy("block").collect()]
    for k, block in enumerate(blocks):
        own = leaves.filter(F.col("block") == block) if len(blocks) > 1 else leaves
        more = block_contributions(features, own)
        if k == 0:
            df = df.withColumn(out, more)
        else:
            df = df.withColumn("_more", more).withColumn(out, F.zip_with(out, "_more", lambda a, b: a + b)).drop("_more")
        if k + 1 < len(blocks) and not df.isStreaming:
            df = materialize(df, "contributions")
    return df


# --- linear models ----------------------------------------------------------------


def feature_means(df: DataFrame, features: str = "features") -> list[float]:
    return [float(v) for v in df.agg(Summarizer.mean(col(features))).first()[0].toArray()]


def linear_shap(df: DataFrame, coefficients, means, features: str = "features", out: str = "shap") -> DataFrame:
    """coefficient * (x - mean): the exact Shapley values of a linear model."""
    w, m = F.lit([float(c) for c in coefficients]), F.lit([float(v) for v in means])
    x = vector_to_array(col(features))
    centred = F.zip_with(x, m, lambda a, b: a - b)
    return df.withColumn(out, F.zip_with(centred, w, lambda a, b: a * b))


# --- one interface over both --------------------------------------------------------


class Explainer:
    """Fitted explanation state: leaf table or coefficients, base value, slot
    names and a background sample.  Saved as tables next to each other."""

    def __init__(self, kind, base, names, background, leaves=None, coefficients=None, means=None):
        self.kind, self.base, self.names, self.background = kind, base, names, background
        self.leaves, self.coefficients, self.means = leaves, coefficients, means

    @classmethod
    def fit(cls, model, train: DataFrame, names: DataFrame, row_id: str, features="features", size=config.BACKGROUND_ROWS, seed=config.SEED):
        background = background_sample(train, row_id, size, seed).select(col(row_id), features)
        if isinstance(model, LinearRegressionModel):
            means = feature_means(train, features)
            base = float(np.dot(model.coefficients.toArray(), means) + model.intercept)
            return cls("linear", base, names, background, coefficients=[float(c) for c in model.coefficients.toArray()], means=means)
        leaves = leaf_table(node_table(model))
        return cls("tree", base_value(leaves), names, background, leaves=leaves)

    def slots(self) -> list:
        return self.names.orderBy("idx").collect()

    def explain(self, df: DataFrame, features: str = "features", out: str = "shap") -> DataFrame:
        if self.kind == "linear":
            return linear_shap(df, self.coefficients, self.means, features, out)
        return tree_shap(df, self.leaves, features, out)

    def save(self, path: str) -> None:
        spark = self.names.sparkSession
        meta = json.dumps({"kind": self.kind, "base": self.base, "coefficients": self.coefficients, "means": self.means})
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")
        self.names.write.mode("overwrite").parquet(f"{path}/feature_names")
        self.background.write.mode("overwrite").parquet(f"{path}/background")
        if self.leaves is not None:
            self.leaves.write.mode("overwrite").parquet(f"{path}/leaves")

    @classmethod
    def load(cls, spark, path: str) -> "Explainer":
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        leaves = spark.read.parquet(f"{path}/leaves") if meta["kind"] == "tree" else None
        return cls(
            meta["kind"],
            meta["base"],
            spark.read.parquet(f"{path}/feature_names"),
            spark.read.parquet(f"{path}/background"),
            leaves=leaves,
            coefficients=meta["coefficients"],
            means=meta["means"],
        )


def background_sample(df: DataFrame, row_id: str, size: int = config.BACKGROUND_ROWS, seed=config.SEED) -> DataFrame:
    """Repeatable sample: the rows with the smallest hash of their id."""
    return df.orderBy(seeded_hash(col(row_id), f"background:{seed}"), col(row_id)).limit(size)


# --- tables from contribution arrays ---------------------------------------------------


def top_contributions(shap, names, sources, originals, values, k: int = config.TOP_CONTRIBUTIONS):
    """Array of the k largest contributions of a row, largest first.  Sorted
    inside the row: no shuffle, and no row is expanded to all its features."""
    ranked = F.slice(
        F.sort_array(F.transform(shap, lambda s, i: F.struct((-F.abs(s)).alias("order"), i.alias("idx"), s.alias("shap")))), 1, k
    )
    return F.transform(
        ranked,
        lambda e, i: F.struct(
            (i + 1).alias("rank"),
            F.get(names, e["idx"]).alias("feature_name"),
            F.coalesce(originals[F.get(sources, e["idx"])], F.get(values, e["idx"]).cast("string")).alias("original_value"),
            e["shap"].alias("shap_value"),
            contribution_type(e["shap"]).alias("contribution_type"),
        ),
    )


def original_values(df: DataFrame, columns) -> Column:
    """Map of column name to the value before any transformation, as text."""
    return F.map_from_arrays(
        F.lit(list(columns)) if columns else F.array().cast("array<string>"),
        F.array(*[col(c).cast("string") for c in columns]) if columns else F.array().cast("array<string>"),
    )


def explain_topk(
    df: DataFrame, slots, k: int = config.TOP_CONTRIBUTIONS, shap: str = "shap", features: str = "features", originals=None
) -> DataFrame:
    """Add ``explanations``; ``originals`` is a map column or None."""
    names = F.lit([s["name"] for s in slots])
    sources = F.lit([s["source_column"] for s in slots])
    lookup = originals if originals is not None else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    values = vector_to_array(col(features))
    return df.withColumn("explanations", top_contributions(col(shap), names, sources, lookup, values, k))


def explode_explanations(df: DataFrame, row_id: str) -> DataFrame:
    return df.select(col(row_id), F.inline("explanations"))


def waterfall(df: DataFrame, row_id: str, base, prediction: str = "prediction") -> DataFrame:
    """Steps of one row: base, its top contributions, the rest, the total.
    Steps and running totals are built inside the row."""
    e = F.col("explanations")
    shown = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x["shap_value"])
    gap = col(prediction) - F.lit(base)
    step = lambda label, amount: F.struct(F.lit(label).alias("feature"), amount.alias("amount"))
    steps = F.concat(
        F.array(step("Base Value", F.lit(base).cast("double"))),
        F.transform(e, lambda x: F.struct(x["feature_name"].alias("feature"), x["shap_value"].alias("amount"))),
        F.array(step("Other features", gap - shown)),
    )
    running = F.transform(
        steps,
        lambda s, i: F.struct(
            i.alias("step"),
            s["feature"].alias("feature"),
            s["amount"].alias("amount"),
            F.aggregate(F.slice(steps, 1, i + 1), F.lit(0.0), lambda acc, x: acc + x["amount"]).alias("running_total"),
        ),
    )
    last = F.struct(
        F.size(steps).alias("step"), F.lit("Predicted Price").alias("feature"), gap.alias("amount"), col(prediction).alias("running_total")
    )
    return df.select(col(row_id), F.inline(F.concat(running, F.array(last))))


def impact_table(df: DataFrame, row_id: str) -> DataFrame:
    """Feature, Impact, Direction, Value per row, smallest impact first.  The
    order is made inside the row, so nothing is shuffled."""
    long = df.select(col(row_id), F.inline(F.reverse("explanations")))
    return long.select(
        col(row_id),
        F.col("feature_name").alias("Feature"),
        F.abs("shap_value").alias("Impact"),
        F.initcap("contribution_type").alias("Direction"),
        F.coalesce("original_value", F.lit("N/A")).alias("Value"),
    )


def feature_importance(model, names: DataFrame, top: int | None = 10) -> DataFrame:
    """Importance of the slots of a tree model, joined with their names."""
    weights = [(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    table = names.sparkSession.createDataFrame(weights, "idx int, importance double")
    out = names.join(table, "idx").select("name", "source_column", "importance").orderBy(F.desc("importance"), "name")
    return out.limit(top) if top else out


def mean_abs_shap(df: DataFrame, slots, shap: str = "shap") -> DataFrame:
    """Mean absolute contribution of each slot: one sum per slot and task, no row is expanded."""
    names = F.lit([s["name"] for s in slots])
    means = df.select(array_to_vector(F.transform(shap, F.abs)).alias("v")).agg(Summarizer.mean(F.col("v")).alias("m"))
    each = means.filter("m IS NOT NULL").select(F.posexplode(vector_to_array("m")).alias("idx", "importance"))
    return each.select(F.get(names, F.col("idx")).alias("name"), "importance")
