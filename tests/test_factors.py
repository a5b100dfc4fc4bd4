import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors as fx, regimes, selection
from tidemark.plans import reports

FEATS = ["lag1_a", "lag1_b", "lag1_flag", "lag1_const"]


def make(days=6, entities=60, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        n = entities if d != 3 else 20  # one thin date
        for e in range(n):
            a = rng.normal()
            rows.append((f"2020010{d + 1}", f"E{e:03d}", a, round(a + rng.normal(), 1), float(rng.random() < 0.3), 1.0, rng.normal(10, 1), rng.random(), a * 0.1 + rng.normal()))
    pdf = pd.DataFrame(rows, columns=["trade_date", "ts_code", *FEATS, "lag1_log_circ_mv", "lag1_turnover_rate_f", "y"])
    pdf.loc[rng.random(len(pdf)) < 0.1, "lag1_a"] = np.nan
    pdf.loc[rng.random(len(pdf)) < 0.1, "lag1_b"] = np.nan
    pdf.loc[rng.random(len(pdf)) < 0.05, "y"] = np.nan
    return pdf


def spark_frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))


@pytest.fixture(params=["10", "1000000"])
def bucket_rows(request, spark):
    spark.conf.set("tidemark.rank.rowsPerBucket", request.param)
    yield
    spark.conf.unset("tidemark.rank.rowsPerBucket")


def test_daily_ic(spark, bucket_rows):
    pdf = make()
    got = fx.daily_ic(spark_frame(spark, pdf), FEATS, "y", 30).toPandas().set_index(["feature", "trade_date"])
    seen = 0
    for f in FEATS:
        for d, g in pdf.dropna(subset=[f, "y"]).groupby("trade_date"):
            if len(g) < 30:
                assert (f, d) not in got.index
                continue
            row = got.loc[(f, d)]
            assert row["n"] == len(g)
            if f == "lag1_const":
                assert pd.isna(row["ic"]) and pd.isna(row["rank_ic"])
            else:
                np.testing.assert_allclose([row["ic"], row["rank_ic"]], [g[f].corr(g["y"]), g[f].rank().corr(g["y"].rank())], rtol=1e-9)
            seen += 1
    assert seen == len(got)


def test_ic_summary_lists_absent_features(spark):
    daily = spark.createDataFrame([("f", "1", 0.1, 0.2, 40), ("f", "2", 0.3, -0.2, 50), ("f", "3", None, None, 60)], "feature string, trade_date string, ic double, rank_ic double, n long")
    got = {r.feature: r for r in fx.ic_summary(daily, ["f", "gone"]).collect()}
    assert (got["f"].days, got["f"].positive_rank_ic_ratio, got["f"].avg_cross_section) == (2, 0.5, 50.0)
    assert got["f"].ic_t_stat == pytest.approx(0.2 / np.std([0.1, 0.3], ddof=1) * np.sqrt(2))
    assert got["gone"].days == 0 and got["gone"].ic_mean is None


def dealt(pdf, f, q, least):
    """Per date a list of q lists of y: rows in order of (value, entity), the k-th of n in part k * q // n."""
    out = {}
    for d in sorted(set(pdf["trade_date"])):
        rows = sorted((r[f], r["ts_code"], r["y"]) for r in pdf[pdf["trade_date"] == d].to_dict("records") if r[f] == r[f] and r["y"] == r["y"])
        if len(rows) < max(q, least) or rows[0][0] == rows[-1][0]:
            continue
        parts = [[] for _ in range(q)]
        for k, (_, _, y) in enumerate(rows):
            parts[k * q // len(rows)].append(y)
        out[d] = parts
    return out


def deepest_fall(returns):
    level = peak = 1.0
    worst = 0.0
    for i, r in enumerate(returns):
        level *= 1 + r
        peak = level if i == 0 else max(peak, level)
        worst = min(worst, level / peak - 1)
    return worst


def test_quantile_spread_and_detail(spark, bucket_rows):
    pdf, q = make(), 7  # 7 does not divide the cross-sections
    df = spark_frame(spark, pdf)
    table = {r["feature"]: r for r in fx.quantile_spread(df, FEATS, "y", q, 30).collect()}
    detail = {(r["feature"], r["quantile"]): r["mean_return"] for r in fx.quantile_detail(df, FEATS, "y", q, 30).collect()}
    assert "lag1_const" not in table
    for f in FEATS[:3]:
        days = dealt(pdf, f, q, 30)
        low, high = ([statistics.fmean(parts[k]) for parts in days.values()] for k in (0, q - 1))
        gaps = [h - x for x, h in zip(low, high, strict=True)]
        row = table[f]
        assert row["days"] == len(gaps)
        assert row["q1_mean_return"] == pytest.approx(statistics.fmean(low)) and row["q_top_mean_return"] == pytest.approx(statistics.fmean(high))
        assert row["long_short_mean_return"] == pytest.approx(statistics.fmean(gaps))
        assert row["long_short_t_stat"] == pytest.approx(statistics.fmean(gaps) / (statistics.stdev(gaps) / len(gaps) ** 0.5))
        assert row["long_short_win_ratio"] == pytest.approx(sum(g > 0 for g in gaps) / len(gaps))
        assert row["long_short_max_drawdown"] == pytest.approx(deepest_fall(gaps))
        for k in range(q):
            pooled = [y for parts in days.values() for y in parts[k]]
            assert detail[f, k + 1] == pytest.approx(statistics.fmean(pooled))
        assert all(max(map(len, parts)) - min(map(len, parts)) <= 1 for parts in days.values())


def test_detail_direction(spark):
    rows = [("1", f"E{i:02d}", float(i), float(i // 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, up double, y double").withColumns({"down": -F.col("up"), "zig": F.col("up") % 3, "flat": F.col("up")})
    got = {r.feature: (r.is_monotonic, r.monotonic_direction) for r in fx.quantile_detail(df, ["up", "down", "zig"], "y", 5, 5).collect()}
    assert got["up"] == (True, "up") and got["down"] == (True, "down") and got["zig"][1] == "none"
    same = fx.quantile_detail(df.withColumn("y", F.lit(1.0)), ["up"], "y", 5, 5).first()
    assert same.monotonic_direction == "up"  # equal means count as rising


def test_empty_input_gives_empty_typed_tables(spark):
    df = spark_frame(spark, make()).limit(0)
    assert fx.quantile_spread(df, FEATS, "y", 5, 30).count() == 0
    assert fx.daily_ic(df, FEATS, "y", 30).count() == 0


def without_parts(y, *others):
    """y less its projections on a constant and the other lists, one orthogonal direction after the other."""
    dot = lambda a, b: sum(x * z for x, z in zip(a, b, strict=True))
    directions = []
    for vector in ([1.0] * len(y), *others):
        left = list(vector)
        for d in directions:
            part = dot(left, d) / dot(d, d)
            left = [x - part * z for x, z in zip(left, d, strict=True)]
        if dot(left, left) > 1e-12 * max(dot(vector, vector), 1e-300):
            directions.append(left)
    left = list(y)
    for d in directions:
        part = dot(left, d) / dot(d, d)
        left = [x - part * z for x, z in zip(left, d, strict=True)]
    return left


def test_neutral_residuals_are_what_projections_leave(spark):
    pdf = make()
    pdf.loc[pdf.trade_date == "20200102", "lag1_turnover_rate_f"] = 1.0  # constant exposure
    pdf.loc[pdf.trade_date == "20200103", "lag1_turnover_rate_f"] = pdf["lag1_log_circ_mv"] * 2 + 1  # dependent exposures
    pdf.loc[(pdf.trade_date == "20200105") & (pdf.ts_code > "E003"), "lag1_log_circ_mv"] = np.nan  # four usable rows
    found = fx.neutral_rows(spark_frame(spark, pdf), [*FEATS, "lag1_log_circ_mv"], "y").collect()
    assert {r["feature"] for r in found} == {f"{f}__neutral" for f in FEATS}
    got = {(r["feature"], r["trade_date"], r["ts_code"]): r["x"] for r in found}
    fitted = 0
    for f in FEATS:
        for d in sorted(set(pdf["trade_date"])):
            rows = pdf[pdf["trade_date"] == d].to_dict("records")
            usable = [r for r in rows if all(r[c] == r[c] for c in (f, "lag1_log_circ_mv", "lag1_turnover_rate_f"))]
            want = {}
            if len(usable) > 4 and len({r[f] for r in usable}) > 1:
                left = without_parts(*[[r[c] for r in usable] for c in (f, "lag1_log_circ_mv", "lag1_turnover_rate_f")])
                want = {r["ts_code"]: x for r, x in zip(usable, left, strict=True)}
                fitted += 1
            for r in rows:
                mine = got[f"{f}__neutral", d, r["ts_code"]]
                assert (mine is None) == (r["ts_code"] not in want)
                assert mine is None or mine == pytest.approx(want[r["ts_code"]], abs=1e-8)
    assert fitted == 15


def test_neutral_ic(spark):
    pdf = make()
    df = spark_frame(spark, pdf)
    got = {r.feature: r.days for r in fx.neutral_ic_summary(df, FEATS, "y", 30).collect()}
    assert got["lag1_a__neutral"] == 5 and got["lag1_const__neutral"] == 0


def test_quality(spark, bucket_rows):
    pdf = make()
    pdf.loc[0, "lag1_a"] = np.inf
    got = fx.quality(spark_frame(spark, pdf).withColumn("lag1_none", F.lit(None).cast("double")), [*FEATS, "lag1_none"]).toPandas().set_index("feature")
    for f in FEATS:
        s = pdf[f].replace([np.inf, -np.inf], np.nan)
        want = [s.isna().mean(), s.notna().mean(), (s == 0).mean(), s.mean(), s.std(), s.min(), s.quantile(0.01), s.quantile(0.5), s.quantile(0.99), s.max(), s.nunique()]
        cols = ["missing_ratio", "finite_ratio", "zero_ratio", "mean", "std", "min", "p01", "p50", "p99", "max", "unique_values"]
        np.testing.assert_allclose(got.loc[f, cols].to_numpy(float), want, rtol=1e-9, atol=1e-12, err_msg=f)
    assert got.loc["lag1_none", "missing_ratio"] == 1 and got.loc["lag1_none", "unique_values"] == 0


def test_correlation_pairs_equal_pandas(spark, bucket_rows):
    pdf = make()
    pdf["lag1_c"] = pdf["lag1_a"].where(pdf["lag1_a"] > -1)  # known on a subset of lag1_a's rows
    pdf["lag1_d"] = pdf["lag1_a"] * -2 + 1  # same rows as lag1_a
    pdf["lag1_thin"] = np.where(np.arange(len(pdf)) < 10, 1.0 * np.arange(len(pdf)), np.nan)
    names = [*FEATS, "lag1_c", "lag1_d", "lag1_thin"]
    got = {(r.feature_left, r.feature_right): r.spearman_corr for r in fx.correlation_pairs(spark_frame(spark, pdf), names, None).collect()}
    want = pdf[names].corr(method="spearman", min_periods=20)
    expected = {(a, b): want.loc[a, b] for i, a in enumerate(names) for b in names[i + 1:] if not pd.isna(want.loc[a, b])}
    assert set(got) == set(expected)
    for pair, value in expected.items():
        assert got[pair] == pytest.approx(value, abs=1e-9)
    top = fx.correlation_pairs(spark_frame(spark, pdf), names, 2).collect()
    assert len(top) == 2 and abs(top[0].spearman_corr) == pytest.approx(1.0)


def test_regimes(spark):
    rng = np.random.default_rng(4)
    days = [f"{20200000 + i}" for i in range(120)]
    pdf = pd.DataFrame({"ts_code": "B", "trade_date": days, "close": 100 + rng.normal(size=120).cumsum(), "amount": rng.integers(1, 30, 120) * 1.0})
    pdf["pre_close"] = pdf["close"].shift(1)
    source = regimes.regime_source(spark_frame(spark, pdf), "B")
    got = regimes.label_regimes(source).toPandas().sort_values("trade_date")["market_regime"].to_numpy()
    ret = pdf["close"] / pdf["close"].shift(20) - 1
    vol = (pdf["close"] / pdf["pre_close"] - 1).rolling(20, min_periods=10).std()
    want = np.select([vol >= vol.quantile(2 / 3), ret >= ret.quantile(2 / 3), ret <= ret.quantile(1 / 3)], ["high_vol", "bull", "bear"], default="sideways")
    assert (got == want).all()
    rank = source.toPandas().sort_values("trade_date")["benchmark_amount_rank_60d"].to_numpy(float)
    np.testing.assert_allclose(rank, pdf["amount"].rolling(60, min_periods=20).rank(pct=True).to_numpy())


def brute_force(rows, corr, limit):
    """The gates, one feature after the other."""
    winners = {}
    for group in selection.NEAR_DUPLICATES:
        inside = [r for r in rows if r["feature"] in group]
        for r in inside:
            winners[r["feature"]] = min(inside, key=lambda x: (-x["score"], x["feature"]))["feature"]
    picked, out = [], {}
    for r in sorted(rows, key=lambda x: (-x["score"], x["feature"])):
        f = r["feature"]
        if r["missing_ratio"] is None or r["missing_ratio"] > 0.35 or r["unique_values"] < 5:
            out[f] = ("drop", "low_coverage_or_low_variation")
        elif any(k in f for k in selection.SEQUENCE_ONLY):
            out[f] = ("advanced", "reserved_for_advanced_or_sequence_model")
        elif winners.get(f, f) != f:
            out[f] = ("advanced", f"pruned_by_collinearity_group:{winners[f]}")
        elif r["rank_ic_mean"] is None and r["long_short_mean_return"] is None:
            out[f] = ("drop", "no_validation_signal")
        else:
            strong = abs(r["rank_ic_mean"] or 0) >= 0.015 or abs(r["long_short_mean_return"] or 0) >= 0.006 or abs(r["long_short_t_stat"] or 0) >= 2
            near = next((p for p in picked if abs(corr.get(frozenset((f, p)), 0)) >= limit), None)
            if strong and near is None:
                picked.append(f)
                out[f] = ("baseline", "stable_cross_section_signal")
            elif strong:
                out[f] = ("advanced", f"correlated_with_baseline:{near}")
            else:
                out[f] = ("advanced", "weak_but_potential_sequence_signal")
    return out


def test_recommendations_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    names = [f"lag1_f{i:02d}" for i in range(25)] + ["lag1_month", "lag1_beta_20d", "lag1_ret_5d", "lag1_ret_5d_mean", "lag1_dead", "lag1_silent"]
    rows = []
    for f in names:
        silent = f == "lag1_silent"
        rows.append({
            "feature": f, "rank_ic_mean": None if silent else float(rng.normal() * 0.02), "long_short_mean_return": None if silent else float(rng.normal() * 0.004),
            "long_short_t_stat": None if silent else float(rng.normal()), "long_short_win_ratio": 0.5, "missing_ratio": 0.9 if f == "lag1_dead" else 0.05, "unique_values": 100, "score": float(round(rng.random(), 1)),
        })
    pairs = [(a, b, float(rng.uniform(-1, 1))) for i, a in enumerate(names) for b in names[i + 1:]]
    scored = spark.createDataFrame(rows, "feature string, rank_ic_mean double, long_short_mean_return double, long_short_t_stat double, long_short_win_ratio double, missing_ratio double, unique_values long, score double")
    corr = spark.createDataFrame(pairs, "feature_left string, feature_right string, spearman_corr double")
    got = {r.feature: (r.recommendation, r.reason) for r in selection.recommend(scored, corr, 0.8).collect()}
    assert got == brute_force(rows, {frozenset(p[:2]): p[2] for p in pairs}, 0.8)
    assert {v[0] for v in got.values()} == {"baseline", "advanced", "drop"}


def test_all_reports_are_written(spark, tmp_path):
    pdf = make(days=9)
    market = pd.DataFrame({"ts_code": "B", "trade_date": sorted(pdf["trade_date"].unique()), "close": np.arange(9) + 10.0, "pre_close": np.arange(9) + 9.0, "amount": 1.0})
    settings = reports.ReportSettings(label="y", train_end="20200106", eval_start="20200107")
    paths = reports.run_reports(spark_frame(spark, pdf), spark_frame(spark, market), "B", str(tmp_path), settings=settings)
    assert len(paths) == 16
    tables = {n: spark.read.parquet(p) for n, p in paths.items()}
    assert tables["factor_ic_rankic"].count() == 6 and tables["feature_quality"].count() == 6
    assert tables["factor_yearly_quantile_long_short"].select("year").distinct().count() == 1
    assert set(r[0] for r in tables["feature_recommendations"].select("recommendation").distinct().collect()) <= {"baseline", "advanced", "drop"}
    with pytest.raises(ValueError):
        reports.windows(spark_frame(spark, pdf), "19990101", None)
    with pytest.raises(ValueError):
        reports.run_reports(spark_frame(spark, pdf), spark_frame(spark, market), "B", str(tmp_path), stages=["nope"])
