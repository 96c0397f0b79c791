import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions import nulls, scalars
from tabwright.functions.normal import inverse_normal_cdf


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        (1, "NA", float("nan"), 5.0, 2000),
        (2, "", float("inf"), None, 2001),
        (3, "None", 2.0, -1.0, None),
        (4, "x", None, 0.0, 1999),
    ]
    return spark.createDataFrame(rows, "id int, text string, a double, b double, year int")


def column(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_missing_markers(frame):
    assert column(frame, nulls.nan_to_null(F.col("a"))) == [None, float("inf"), 2.0, None]
    assert column(frame, nulls.infinity_to_null(F.col("a"))) == [None, None, 2.0, None]
    assert column(frame, nulls.tokens_to_null(F.col("text"), ["NA", ""])) == [None, None, "None", "x"]
    assert column(frame, nulls.text_or_nan(F.col("year"))) == ["2000", "2001", "nan", "1999"]
    assert column(frame, nulls.safe_double(F.col("text"))) == [None] * 4


def test_clip_keeps_missing(frame):
    assert column(frame, scalars.clip_lower(F.col("b"), 0.0)) == [5.0, None, 0.0, 0.0]
    assert column(frame, scalars.clip_upper(F.col("b"), 1.0)) == [1.0, None, -1.0, 0.0]


def test_flags_on_missing(frame):
    assert column(frame, scalars.differs(F.col("year"), F.lit(2000))) == [0, 1, 1, 1]
    assert column(frame, scalars.is_positive(F.col("b"))) == [1, 0, 0, 0]
    assert column(frame, scalars.non_negative_diff(F.lit(2000), F.col("year"))) == [0, 0, None, 1]


def test_percent_error_of_zero_is_missing(frame):
    assert column(frame, scalars.percent_error(F.col("b"), F.lit(1.0))) == [80.0, None, 200.0, None]


def test_texts(frame):
    assert column(frame, scalars.currency_text(F.lit(1234.5)))[0] == "$1,234.50"
    assert column(frame, scalars.percent_text(F.lit(0.855)))[0] == "85.5%"
    assert [column(frame, scalars.confidence_color(F.lit(v)))[0] for v in (0.8, 0.6, 0.59)] == ["green", "orange", "red"]
    assert column(frame, scalars.clean_feature_name(F.lit("cat__cat__x")))[0] == "cat__x"
    assert column(frame, scalars.contribution_type(F.lit(0.0)))[0] == "negative"
    text = column(frame, scalars.contribution_sentence(F.lit(-1.0), F.lit("f"), F.lit(None).cast("string")))[0]
    assert text == "lowers the price by $1.00 through f=None"


def test_inverse_normal_matches_standard_library():
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 501), [1e-7, 1 - 1e-7, 1e-15]])
    want = [statistics.NormalDist().inv_cdf(x) for x in p]
    assert np.abs(inverse_normal_cdf(p) - want).max() < 1e-12


def test_cyclic_months(spark):
    sin, cos = scalars.cyclic(F.col("m").cast("double"), 12)
    rows = spark.range(1, 13).withColumnRenamed("id", "m").select("m", sin, cos).collect()
    for m, s, c in rows:
        assert s == pytest.approx(np.sin(2 * np.pi * m / 12)) and c == pytest.approx(np.cos(2 * np.pi * m / 12))
