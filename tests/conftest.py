import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tabwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales(spark):
    from fixtures import synthetic_sales

    columns = (
        "Id SalePrice Neighborhood BldgType MSZoning MSSubClass ExterQual KitchenQual BsmtQual OverallQual GrLivArea LotArea "
        "LotFrontage GarageYrBlt MasVnrArea TotalBsmtSF 1stFlrSF 2ndFlrSF FullBath HalfBath YearBuilt YearRemodAdd YrSold MoSold"
    ).split()
    return synthetic_sales(spark, 600).select(*columns).cache()
