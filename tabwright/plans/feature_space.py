"""The whole feature pipeline of a wide table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tabwright.config import TableConfig
from tabwright.functions.nulls import col, nan_columns_to_null, numeric_columns, string_columns
from tabwright.operators.assembly import FeatureRouter, feature_name_table
from tabwright.operators.domain import DomainFeatures, DomainFeaturesModel
from tabwright.operators.encoders import (
    MissingFlagsModel,
    OneHotLevels,
    OneHotLevelsModel,
    OrdinalMapper,
    RarePooler,
    RarePoolerModel,
    TargetEncoder,
)
from tabwright.operators.imputers import ImputerModel, SanitizerModel
from tabwright.operators.lookup import most_frequent
from tabwright.operators.profile import missing_counts
from tabwright.operators.projection import feature_columns
from tabwright.operators.quantiles import exact_quantiles
from tabwright.operators.scaling import QuantileNormalModel
from tabwright.operators.stage import StageTransformer, param


class AsCategory(StageTransformer):
    """Numbers that are codes are treated as text."""

    cols = param("cols", "columns cast to text")
    DEFAULTS = {"cols": []}

    def _transform(self, df: DataFrame) -> DataFrame:
        casts = {c: col(c).cast("string") for c in self.value("cols") if c in df.columns}
        return df.withColumns(casts) if casts else df


def fit_feature_space(
    train: DataFrame,
    config: TableConfig,
    label: str = "label",
    test: DataFrame | None = None,
    reserved=("label", "split", "fold"),
) -> PipelineModel:
    """Fit the whole feature pipeline.  ``reserved`` columns and the row id are
    never features.  Select what is needed next to the vector: the optimizer
    prunes the rest.

    Each question is asked once: the gaps of all columns answer routing, flags
    and empty columns; the level counts answer pooling and one-hot slots; the
    medians and the knots of the quantile scale come from one job."""
    out = set(reserved) | {config.row_id, label}
    stages: list = []

    def add(model, df):
        stages.append(model)
        return model.transform(df)

    df = train
    if config.domain_features:
        df = add(DomainFeatures(aliases=config.aliases, scope=config.quantile_scope).fit(df), df)
    df = add(AsCategory(cols=config.as_category), df)
    cols = feature_columns(df, out)
    ordinal = [c for c in config.ordinal_levels if c in cols]
    categorical = string_columns(df, out | set(ordinal))
    df = add(OrdinalMapper(mapping={c: config.ordinal_levels[c] for c in ordinal}), df)

    numbers = [c for c in numeric_columns(df) if c in cols]
    rows, gaps = missing_counts(df, numbers)
    present = {c: rows - n for c, n in gaps.items()}
    gaps_to_route = gaps
    if test is not None and numbers:
        test_gaps = missing_counts(PipelineModel(list(stages)).transform(test), numbers)[1]
        gaps_to_route = {c: gaps[c] + test_gaps[c] for c in numbers}
    numeric = [c for c in numbers if c not in ordinal]
    complete = [c for c in numeric if not gaps_to_route[c]]
    partial = [c for c in numeric if gaps_to_route[c]]

    flags = MissingFlagsModel(cols=[c for c in numbers if gaps[c]])
    pooler = RarePooler(cols=categorical, minCount=config.rare_min_count, minShare=config.rare_min_share).fit(df)
    pooled = pooler.transform(df)
    encoder = TargetEncoder(
        cols=[c for c in config.target_encoded if c in categorical], labelCol=label, alpha=config.smoothing
    ).fit(pooled)
    medians, knots = _numeric_quantiles(df, complete, partial, rows, config)
    fills = {**_modes(df, ordinal), **{c: v for c, v in medians.items() if v is not None}}

    stages += [flags, pooler, encoder, ImputerModel(fills=fills, numeric=list(medians))]
    stages.append(QuantileNormalModel(cols=complete, knots=[knots[c] for c in complete]))
    scalars = ordinal + complete + partial + encoder.output_columns() + flags.output_columns()
    empty = [c for c in numbers if present[c] == 0]
    stages.append(SanitizerModel(dropped=empty, cols=scalars))
    one_hot = one_hot_from_pool(pooler, rows) or OneHotLevels(cols=categorical).fit(pooled)
    stages.append(one_hot)

    kinds = {c: "ordinal" for c in ordinal}
    kinds |= {c: "numeric_complete" for c in complete} | {c: "numeric_missing" for c in partial}
    kinds |= {c: "target_mean" for c in encoder.output_columns()} | {c: "missing_flag" for c in flags.output_columns()}
    sources = dict(zip(encoder.output_columns(), encoder.value("cols")))
    sources |= dict(zip(flags.output_columns(), flags.value("cols")))
    stages.append(
        FeatureRouter(
            oneHot=[
                list(block) for block in zip(categorical, one_hot.output_columns(), one_hot.value("labels"), one_hot.value("sizes"))
            ],
            scalars=[[c, sources.get(c, c), kinds[c]] for c in scalars if c not in empty],
        )
    )
    return PipelineModel(stages)


def _modes(df: DataFrame, ordinal) -> dict:
    return {c: v for c, v in most_frequent(df, ordinal).items() if v is not None}


def _numeric_quantiles(df, complete, partial, rows, config):
    """Medians of all numeric columns, and the quantile knots of complete ones."""
    n = max(2, min(config.n_quantiles, rows))
    grid = [i / (n - 1) for i in range(n)]
    clean = nan_columns_to_null(df.select(*[col(c) for c in complete + partial]))
    found = exact_quantiles(clean, {c: [0.5, *grid] for c in complete} | {c: [0.5] for c in partial})
    return {c: v[0] for c, v in found.items()}, {c: found[c][1:] for c in complete}


def one_hot_from_pool(pooler: RarePoolerModel, rows: int) -> OneHotLevelsModel | None:
    """The levels after pooling are the kept ones and, where rows are left, the
    pooled one: no further pass.  None when a level table is too long."""
    table, other, found = pooler.levels, pooler.value("other"), []
    for c in pooler.value("cols"):
        if c not in table.literals:
            return None
        counts = dict(table.counts[c])
        rest = rows - sum(counts.values())
        if rest:
            counts[other] = counts.get(other, 0) + rest
        found.append(counts)
    return OneHotLevelsModel.of_counts(found, cols=pooler.value("cols"))


def router_of(model: PipelineModel) -> FeatureRouter:
    return next(s for s in reversed(flat_stages(model)) if isinstance(s, FeatureRouter))


def flat_stages(model: PipelineModel) -> list:
    out = []
    for s in model.stages:
        out += flat_stages(s) if isinstance(s, PipelineModel) else [s]
    return out


def feature_names(model: PipelineModel) -> DataFrame:
    from pyspark.sql import SparkSession

    wide = [s.levels for s in flat_stages(model) if isinstance(s, OneHotLevelsModel) and s.levels]
    return feature_name_table(SparkSession.active(), router_of(model), *wide[:1])


def expected_columns(model: PipelineModel) -> dict[str, str]:
    """Column -> kind the fitted pipeline reads, derived features included."""
    router = router_of(model)
    expected = {c: "string" for c, *_ in router.value("oneHot")}
    expected |= {
        c: "string" if kind == "ordinal" else "double"
        for c, _, kind in (tuple(s) for s in router.value("scalars"))
        if kind in ("ordinal", "numeric_complete", "numeric_missing")
    }
    return expected
