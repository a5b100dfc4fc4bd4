import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import recurrences as rc


def prices(entities, days, gaps, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        close = 20 + rng.normal(size=days).cumsum() * 0.1
        close[rng.random(days) < gaps] = np.nan
        if gaps:
            close[:3] = np.nan
            close[60:400] = np.nan
        rows.append(pd.DataFrame({"ts_code": f"E{e}", "trade_date": [f"{d:08d}" for d in range(days)], "close": close, "low": close - rng.random(days), "high": close + rng.random(days)}))
    return pd.concat(rows, ignore_index=True)


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "ts_code string, trade_date string, close double, low double, high double").repartition(3)


def ordered(df):
    return df.toPandas().sort_values(["ts_code", "trade_date"], ignore_index=True)


@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_ema_equals_pandas(spark, gaps):
    pdf = prices(3, 900, gaps)
    got = ordered(rc.with_ema(frame(spark, pdf), {"a": ("close", 9, 9), "b": ("close", 26, 1), "c": ("close", 2, 2), "d": ("close", 500, 30)}))
    for name, span, need in (("a", 9, 9), ("b", 26, 1), ("c", 2, 2), ("d", 500, 30)):
        want = pdf.groupby("ts_code")["close"].transform(lambda v, span=span, need=need: v.ewm(span=span, adjust=False, min_periods=need).mean())
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(), rtol=1e-11)


def plain_kdj(rows, n=9):
    out, k, d, known = [], 50.0, 50.0, False
    for i in range(len(rows)):
        last = rows.iloc[max(0, i - n + 1) : i + 1]
        low, high, close = last["low"].min(), last["high"].max(), rows.iloc[i]["close"]
        enough = min(last["low"].count(), last["high"].count()) >= 4
        rsv = 100 * (close - low) / (high - low) if enough and high != low and close == close else None
        if rsv is not None:
            known, k = True, k * 2 / 3 + rsv / 3
        if known:
            d = d * 2 / 3 + k / 3
        out.append((rsv, k, d, 3 * k - 2 * d) if known else (None,) * 4)
    return np.array(out, dtype=float)


@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_kdj_by_plain_loops(spark, gaps):
    pdf = prices(2, 700, gaps)
    got = ordered(rc.kdj(frame(spark, pdf)))
    want = np.concatenate([plain_kdj(own) for _, own in pdf.groupby("ts_code")])
    np.testing.assert_allclose(got[["kdj_rsv", "kdj_k", "kdj_d", "kdj_j"]].to_numpy(float), want, rtol=1e-9, atol=1e-9)


def test_long_histories(spark):
    pdf = prices(4, 10_000, 0.0)
    got = ordered(rc.macd(frame(spark, pdf)))
    means = [pdf.groupby("ts_code")["close"].transform(lambda v, s=s: v.ewm(span=s, adjust=False, min_periods=s).mean()) for s in (12, 26)]
    diff = means[0] - means[1]
    dea = diff.groupby(pdf["ts_code"]).transform(lambda v: v.ewm(span=9, adjust=False, min_periods=9).mean())
    np.testing.assert_allclose(got["macd_diff"].to_numpy(float), diff.to_numpy(), rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(got["macd_dea"].to_numpy(float), dea.to_numpy(), rtol=1e-8, atol=1e-10)


def test_affine_maps_of_any_kind(spark):
    rows = [("E", f"{i:08d}", 0.5 + (i % 7) / 4, (-1.0) ** i * i) for i in range(300)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date string, a double, b double")
    got = [r["y"] for r in rc.affine_scan(df, {"y": (F.col("a"), F.col("b"))}, {"y": 3.0}).orderBy("trade_date").collect()]
    y, want = 3.0, []
    for _, _, a, b in rows:
        y = a * y + b
        want.append(y)
    np.testing.assert_allclose(got, want, rtol=1e-7)
    assert rc.affine_scan(df.limit(0), {"y": (F.col("a"), F.col("b"))}).count() == 0
    with pytest.raises(ValueError, match="span"):
        rc.with_ema(df, {"m": ("a", 1, 1)})
