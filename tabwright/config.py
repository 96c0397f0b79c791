"""Settings for the property-sales schema.  Every operator takes column names
as parameters; the dataclass at the end is one bundle of such parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
# Level orders, worst first; the rank of a level is its position.
ORDINAL_LEVELS = {
    "ExterQual": ["Po", "Fa", "TA", "Gd", "Ex"],
    "ExterCond": ["Po", "Fa", "TA", "Gd", "Ex"],
    "BsmtQual": ["NA", "Po", "Fa", "TA", "Gd", "Ex"],
    "BsmtCond": ["NA", "Po", "Fa", "TA", "Gd", "Ex"],
    "BsmtExposure": ["NA", "No", "Mn", "Av", "Gd"],
    "BsmtFinType1": ["NA", "Unf", "LwQ", "Rec", "BLQ", "ALQ", "GLQ"],
    "BsmtFinType2": ["NA", "Unf", "LwQ", "Rec", "BLQ", "ALQ", "GLQ"],
    "HeatingQC": ["Po", "Fa", "TA", "Gd", "Ex"],
    "KitchenQual": ["Po", "Fa", "TA", "Gd", "Ex"],
    "FireplaceQu": ["NA", "Po", "Fa", "TA", "Gd", "Ex"],
    "GarageFinish": ["NA", "Unf", "RFn", "Fin"],
    "GarageQual": ["NA", "Po", "Fa", "TA", "Gd", "Ex"],
    "GarageCond": ["NA", "Po", "Fa", "TA", "Gd", "Ex"],
    "PoolQC": ["NA", "Fa", "TA", "Gd", "Ex"],
    "Fence": ["NA", "MnWw", "GdWo", "MnPrv", "GdPrv"],
    "Functional": ["Sal", "Sev", "Maj2", "Maj1", "Mod", "Min2", "Min1", "Typ"],
    "PavedDrive": ["N", "P", "Y"],
    "Street": ["Grvl", "Pave"],
    "Alley": ["NA", "Grvl", "Pave"],
    "CentralAir": ["N", "Y"],
}

# Request field -> column name used in the data.
ALIASES = {
    "FirstFlrSF": "1stFlrSF",
    "SecondFlrSF": "2ndFlrSF",
    "ThreeSsnPorch": "3SsnPorch",
}

# Request fields by type, in schema order.
REQUEST_FIELDS = {
    "MSSubClass": "int", "MSZoning": "string", "LotFrontage": "double", "LotArea": "int",
    "Street": "string", "Alley": "string", "LotShape": "string", "LandContour": "string",
    "Utilities": "string", "LotConfig": "string", "LandSlope": "string", "Neighborhood": "string",
    "Condition1": "string", "Condition2": "string", "BldgType": "string", "HouseStyle": "string",
    "OverallQual": "int", "OverallCond": "int", "YearBuilt": "int", "YearRemodAdd": "int",
    "RoofStyle": "string", "RoofMatl": "string", "Exterior1st": "string", "Exterior2nd": "string",
    "MasVnrType": "string", "MasVnrArea": "double", "ExterQual": "string", "ExterCond": "string",
    "Foundation": "string", "BsmtQual": "string", "BsmtCond": "string", "BsmtExposure": "string",
    "BsmtFinType1": "string", "BsmtFinSF1": "double", "BsmtFinType2": "string",
    "BsmtFinSF2": "double", "BsmtUnfSF": "double", "TotalBsmtSF": "double", "Heating": "string",
    "HeatingQC": "string", "CentralAir": "string", "Electrical": "string", "FirstFlrSF": "int",
    "SecondFlrSF": "int", "LowQualFinSF": "int", "GrLivArea": "int", "BsmtFullBath": "int",
    "BsmtHalfBath": "int", "FullBath": "int", "HalfBath": "int", "BedroomAbvGr": "int",
    "KitchenAbvGr": "int", "KitchenQual": "string", "TotRmsAbvGrd": "int", "Functional": "string",
    "Fireplaces": "int", "FireplaceQu": "string", "GarageType": "string", "GarageYrBlt": "double",
    "GarageFinish": "string", "GarageCars": "int", "GarageArea": "double", "GarageQual": "string",
    "GarageCond": "string", "PavedDrive": "string", "WoodDeckSF": "int", "OpenPorchSF": "int",
    "EnclosedPorch": "int", "ThreeSsnPorch": "int", "ScreenPorch": "int", "PoolArea": "int",
    "PoolQC": "string", "Fence": "string", "MiscFeature": "string", "MiscVal": "int",
    "MoSold": "int", "YrSold": "int", "SaleType": "string", "SaleCondition": "string",
}

# Values a batch record starts from before its own fields override them.
RECORD_DEFAULTS = {
    "BsmtCond": "TA", "BsmtExposure": "No", "BsmtFinSF1": 706, "BsmtFinSF2": 0,
    "BsmtFinType1": "GLQ", "BsmtFinType2": "Unf", "BsmtFullBath": 1, "BsmtHalfBath": 0,
    "BsmtQual": "Gd", "BsmtUnfSF": 150, "CentralAir": "Y", "Condition1": "Norm",
    "Condition2": "Norm", "Electrical": "SBrkr", "EnclosedPorch": 0, "ExterCond": "TA",
    "ExterQual": "Gd", "Exterior1st": "VinylSd", "Exterior2nd": "VinylSd", "FireplaceQu": "Gd",
    "Foundation": "PConc", "Functional": "Typ", "GarageCond": "TA", "GarageFinish": "RFn",
    "GarageQual": "TA", "GarageType": "Attchd", "GarageYrBlt": 2003, "Heating": "GasA",
    "HeatingQC": "Ex", "KitchenQual": "Gd", "LandContour": "Lvl", "LandSlope": "Gtl",
    "LotConfig": "Inside", "LotShape": "Reg", "MSSubClass": 60, "MSZoning": "RL",
    "MasVnrArea": 196, "MasVnrType": "BrkFace", "MiscVal": 0, "MoSold": 2, "OpenPorchSF": 61,
    "PavedDrive": "Y", "PoolArea": 0, "PoolQC": "NA", "RoofMatl": "CompShg",
    "RoofStyle": "Gable", "SaleCondition": "Normal", "SaleType": "WD", "ScreenPorch": 0,
    "Street": "Pave", "ThreeSsnPorch": 0, "Utilities": "AllPub", "WoodDeckSF": 0,
    "YearRemodAdd": 2003, "YrSold": 2008, "LowQualFinSF": 0, "HouseStyle": "2Story",
    "BldgType": "1Fam", "Alley": "NA",
}

# Columns the domain features need, with the value used when a column is absent.
ABSENT_NUMERIC_DEFAULTS = {
    "YrSold": 0, "YearBuilt": 0, "YearRemodAdd": 0, "OverallQual": 5, "GrLivArea": 0, "LotArea": 0,
}
FLOOR_COLUMNS = [["TotalBsmtSF", "1stFlrSF", "2ndFlrSF"], ["TotalBsmtSF", "FirstFlrSF", "SecondFlrSF"]]
PORCH_COLUMNS = ["OpenPorchSF", "EnclosedPorch", "3SsnPorch", "ScreenPorch", "WoodDeckSF"]
NON_NEGATIVE_FIELDS = [
    "LotArea", "LotFrontage", "GrLivArea", "TotalBsmtSF", "1stFlrSF", "2ndFlrSF", "YearBuilt",
]
RECOMMENDED_FIELDS = ["LotArea", "OverallQual", "GrLivArea"]
TARGET_ENCODED = [
    "Neighborhood", "MSZoning", "Exterior1st", "Exterior2nd", "SaleCondition", "BldgType",
]
TARGET_SMOOTHING = 30.0
RARE_MIN_COUNT = 15
N_QUANTILES = 200
TEST_SIZE = 0.2
SEED = 42
CV_FOLDS = 5
SEARCH_TRIALS = 15
SEARCH_TOP_MODELS = 5
CONFIDENCE = 0.85
BACKGROUND_ROWS = 100
TOP_CONTRIBUTIONS = 10

# Rule imputation: constant "None" columns, and the other rules by column.
FILL_NONE_COLUMNS = [
    "PoolQC", "MiscFeature", "Alley", "Fence", "FireplaceQu", "GarageType", "GarageFinish",
    "GarageQual", "GarageCond", "BsmtExposure", "BsmtQual", "BsmtCond", "BsmtFinType1",
    "BsmtFinType2", "MasVnrType",
]
IMPUTE_RULES = {
    **{c: ("constant", "None") for c in FILL_NONE_COLUMNS},
    "Electrical": ("mode", None),
    "MasVnrArea": ("constant", 0),
    "GarageYrBlt": ("constant", 0),
    "LotFrontage": ("median", None),
}

# Prefixes removed (first match only) to show a plain feature name.
FEATURE_PREFIXES = [
    "TargetEncoder_", "OneHotEncoder_", "OrdinalEncoder_", "StandardScaler_", "MinMaxScaler_",
    "RobustScaler_", "QuantileTransformer_", "PowerTransformer_", "remainder__", "passthrough_",
    "cat__", "num_cont__", "num_abs__", "ord__",
]

# Text values a CSV reader treats as missing (the usual data-frame reader list).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# --- end of fixed values ----------------------------------------------------


def data_schema_fields() -> dict[str, str]:
    """Request fields under their data names."""
    return {ALIASES.get(name, name): kind for name, kind in REQUEST_FIELDS.items()}


@dataclass
class TableConfig:
    """Column roles of one table; the defaults describe property sales."""

    row_id: str = "Id"
    target: str = "SalePrice"
    aliases: dict = field(default_factory=lambda: dict(ALIASES))
    ordinal_levels: dict = field(default_factory=lambda: dict(ORDINAL_LEVELS))
    as_category: list = field(default_factory=lambda: ["MSSubClass"])
    target_encoded: list = field(default_factory=lambda: list(TARGET_ENCODED))
    smoothing: float = TARGET_SMOOTHING
    rare_min_count: int | None = RARE_MIN_COUNT
    rare_min_share: float | None = None
    n_quantiles: int = N_QUANTILES
    domain_features: bool = True
    quantile_scope: str = "fit"  # "frame" clips every frame at its own quantile
