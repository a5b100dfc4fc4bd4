import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as s, windows as w


def one(spark, **columns):
    return spark.createDataFrame([columns])


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_division_and_finite_never_leave_nan_or_inf(spark):
    rows = [(1.0, 0.0), (float("inf"), 2.0), (float("nan"), 1.0), (3.0, 2.0), (None, 1.0)]
    assert values(spark, s.sdiv("a", "b"), [rows[0], rows[3]], "a double, b double") == [None, 1.5]
    assert values(spark, s.finite("a"), rows, "a double, b double") == [1.0, None, None, 3.0, None]
    assert values(spark, s.finite("t"), [("x",), ("1.5",)], "t string") == [None, 1.5]


def test_date_text(spark):
    rows = [("20200101.0",), ("20200101",), ("nan",), ("<NA>",), ("None",), (None,)]
    assert values(spark, s.date_text("t"), rows, "t string") == ["20200101", "20200101", None, None, None, None]


def test_tick_rounding_is_half_even(spark):
    rows = [(0.5,), (1.5,), (2.5,), (-0.5,)]
    assert values(spark, s.round_to_tick("x", 1.0), rows, "x double") == [0.0, 2.0, 2.0, -0.0]


def test_clip_keeps_nulls(spark):
    rows = [(None,), (5.0,), (-5.0,)]
    assert values(spark, s.clip("x", F.lit(-1.0), F.lit(1.0)), rows, "x double") == [None, 1.0, -1.0]
    assert values(spark, s.clip("x", F.lit(None).cast("double"), F.lit(1.0)), rows, "x double") == [None, 1.0, -5.0]


def series(gaps=True):
    rng = np.random.default_rng(5)
    frames = []
    for e in ("a", "b"):
        x = rng.normal(size=90).cumsum() + 50
        if gaps:
            x[[0, 1, 7, 20, 21, 22, 60]] = np.nan
        frames.append(pd.DataFrame({"ts_code": e, "trade_date": [f"{d:08d}" for d in range(90)], "x": x}))
    return pd.concat(frames, ignore_index=True)


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "ts_code string, trade_date string, x double")


@pytest.mark.parametrize("fn,pd_fn", [("avg", "mean"), ("stddev_samp", "std"), ("max", "max")])
def test_rolling_equals_pandas(spark, fn, pd_fn):
    pdf = series()
    got = frame(spark, pdf).withColumn("r", w.rolling(fn, "x", 20, 10)).toPandas().sort_values(["ts_code", "trade_date"])
    want = pdf.groupby("ts_code")["x"].transform(lambda v: getattr(v.rolling(20, min_periods=10), pd_fn)())
    np.testing.assert_allclose(got["r"].to_numpy(float), want.to_numpy(), rtol=1e-10)


def test_rolling_rank_equals_pandas(spark):
    pdf = series()
    pdf["x"] = pdf["x"].round(0)
    got = frame(spark, pdf).withColumn("r", w.rolling_rank_pct("x", 30, 10)).toPandas().sort_values(["ts_code", "trade_date"])
    want = pdf.groupby("ts_code")["x"].transform(lambda v: v.rolling(30, min_periods=10).rank(pct=True))
    np.testing.assert_allclose(got["r"].to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_trailing_matrix_needs_full_null_free_window(spark):
    rows = [("a", f"{d}", float(d), None if d == 2 else 1.0) for d in range(6)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date string, p double, q double")
    got = {r.trade_date: r.m for r in df.withColumn("m", w.trailing_matrix(["p", "q"], 3)).collect()}
    assert [d for d, m in got.items() if m is not None] == ["5"]
    assert got["5"] == [[3.0, 1.0], [4.0, 1.0], [5.0, 1.0]]
