import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, coverage, membership as m, state as st
from tidemark.operators.panel import latest


def snapshots(spark, rows):
    return spark.createDataFrame([("I", c, d, w) for c, d, w in rows], "index_code string, ts_code string, trade_date string, index_weight double")


def spans(df):
    return sorted(tuple(r) for r in df.select("ts_code", "effective_from", "effective_to", "index_weight", "is_active").collect())


def test_exit_and_reentry(spark):
    rows = [("A", "20200101", 1.0), ("A", "20200201", 2.0), ("A", "20200401", 3.0), ("B", "20200201", 5.0), ("B", "20200301", 6.0), ("C", "20200401", None)]
    got = spans(m.build_intervals(snapshots(spark, rows), "v"))
    assert got == [
        ("A", "20200101", "20200201", 2.0, False), ("A", "20200401", "99991231", 3.0, True),
        ("B", "20200201", "20200301", 6.0, False), ("C", "20200401", "99991231", None, True),
    ]
    later = spans(m.build_intervals(snapshots(spark, rows), "v", close_at="day_before_change"))
    assert later[0] == ("A", "20200101", "20200229", 2.0, False)


def test_random_snapshots_round_trip(spark):
    rng = random.Random(11)
    days = [f"2020{i:02d}01" for i in range(1, 13)]
    held = {(f"E{e}", d) for e in range(15) for d in days if rng.random() < 0.5}
    last = max(d for _, d in held)
    known = sorted({d for _, d in held})
    built = m.build_intervals(snapshots(spark, [(e, d, 1.0) for e, d in held]), "v").collect()
    back = {(r.ts_code, d) for r in built for d in known if r.effective_from <= d <= r.effective_to}
    assert back == held
    assert all(r.is_active == ((r.ts_code, last) in held and r.effective_to == m.OPEN_END) for r in built)
    assert m.interval_violations(spark.createDataFrame(built)).isEmpty()


def test_normalize_keeps_latest_copy(spark):
    raw = spark.createDataFrame(
        [("I", "A", "20200101.0", "1.5", 1), ("I", "A", "20200101", "2.5", 2), ("J", "A", "20200101", "9", 3), ("I", None, "20200101", "1", 1), ("I", "B", "20200101", "bad", 1)],
        "index_code string, con_code string, trade_date string, weight string, at int",
    )
    got = sorted(tuple(r) for r in m.normalize_snapshots(raw, "I", ["at"]).collect())
    assert got == [("I", "A", "20200101", 2.5), ("I", "B", "20200101", None)]
    with pytest.raises(ValueError):
        m.normalize_snapshots(raw.drop("weight"), "I")


def test_violations_and_prefilter(spark):
    df = spark.createDataFrame(
        [("I", "A", "20200101", "20200131"), ("I", "A", "20200131", "20200301"), ("I", "B", "20200301", "20200201"), ("I", "C", "20200101", "20200102")],
        "index_code string, ts_code string, effective_from string, effective_to string",
    )
    got = {(r.ts_code, r.violation) for r in m.interval_violations(df).collect()}
    assert got == {("A", "overlap"), ("B", "starts_after_end")}
    assert {r.ts_code for r in m.intervals_touching(df, "20200201", "20200228").collect()} == {"A"}
    panel = spark.createDataFrame([("A", "20200131"), ("A", "20200305"), ("D", "20200101")], "ts_code string, trade_date string")
    assert [tuple(r) for r in m.members_only(panel, df).collect()] == [("A", "20200131")]  # in two intervals, kept once


def test_pending_membership_files(spark):
    registry = spark.createDataFrame(
        [("index_weight", "/s/X_1.csv", "X_1.csv", "m1", "/raw", "ingested"), ("index_weight", "/s/X_2.csv", "X_2.csv", "m2", "/raw", "ingested"), ("daily", "/s/X_3.csv", "X_3.csv", "m3", "/raw", "ingested")],
        "dataset string, source_path string, filename string, md5 string, raw_path string, status string",
    )
    seen = spark.createDataFrame([("X", "/s/X_1.csv", "old", 1), ("X", "/s/X_1.csv", "m1", 2)], "index_code string, source_path string, md5 string, processed_at int")
    assert [r.source_path for r in m.pending_membership_files(registry, seen, "X").collect()] == ["/s/X_2.csv"]
    assert m.pending_membership_files(registry, seen.unionByName(spark.createDataFrame([("X", "/s/X_2.csv", "m2", 3)], seen.schema)), "X").isEmpty()


def test_latest_takes_most_recent(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, None)], "k string, t int, v string")
    assert sorted((tuple(r) for r in latest(df, ["k"], ["t"]).collect())) == [("j", 1, None), ("k", 3, "c")]


def cal(spark):
    return spark.createDataFrame(
        [("20200102", "1"), ("20200103", "1"), ("20200104", "0"), ("20200106", "1"), ("20200106.0", "1"), (None, "1"), ("20200107", "x")],
        "cal_date string, is_open string",
    )


def test_listed_days(spark):
    days = calendar.open_days(cal(spark))
    assert [tuple(r) for r in days.orderBy("cal_date").collect()] == [("20200102", 0), ("20200103", 1), ("20200106", 2)]
    rows = [
        ("20200106", "20200102", 3), ("20200106", "20200106", 1), ("20200106", "20200104", 1), ("20200106", "20190101", 3),
        ("20200106", "20210101", 0), ("20200106", None, 0), ("20200104", "20200102", 0), ("20200102", "20200106", 0),
    ]
    df = spark.createDataFrame(rows, "trade_date string, list_date string, want int")
    assert all(r.listed_days == r.want for r in calendar.with_listed_days(df, days).collect())
    plain = calendar.with_listed_days(df.where("list_date = '20200102' and trade_date = '20200106'"), None)
    assert plain.first().listed_days == 4


RULES = {
    "tick_size": 0.01, "price_tolerance": 1e-6,
    "boards": {
        "one": {"code_patterns": [r"^1\d+$"], "reforms": [
            {"effective_from": "20200101", "normal_limit_ratio": 0.1, "st_limit_ratio": 0.05, "ipo_no_limit_trading_days": 0},
            {"effective_from": "20200601", "normal_limit_ratio": 0.2, "st_limit_ratio": 0.2, "ipo_no_limit_trading_days": 5}]},
        "two": {"code_patterns": [r"^1[5-9]\d*$"], "reforms": [
            {"effective_from": "20200101", "normal_limit_ratio": 0.3, "st_limit_ratio": 0.3, "ipo_no_limit_trading_days": 0}]},
    },
}


def test_limit_rules(spark):
    rows = [
        ("before", "10", "20190101", False, 9, 10.0, 11.0), ("reform", "10", "20200601", False, 9, 10.0, 12.0), ("st", "10", "20200101", True, 9, 10.0, 9.5),
        ("ipo", "10", "20200601", False, 5, 10.0, 50.0), ("later_board", "15", "20200601", False, 9, 10.0, 10.0), ("nolist", "10", "20200101", False, 0, 10.0, 10.0),
        ("fallback", "9", "20200101", False, 9, 10.0, 11.0), ("noprev", "10", "20200101", False, 9, None, 11.0), ("cyb", "9", "20200101", False, 9, 10.0, 10.0),
    ]
    df = spark.createDataFrame(rows, "name string, ts_code string, trade_date string, is_st boolean, listed_days long, pre_close double, close double").withColumn(
        "market", F.when(F.col("name") == "cyb", "chinext board"))
    got = {r.name: r for r in st.with_price_limits(df, RULES).collect()}
    assert (got["before"].limit_ratio, got["before"].limit_rule_id, got["before"].is_limit_up) == (0.1, "one_20200101_normal", True)
    assert (got["reform"].limit_ratio, got["reform"].limit_rule_id) == (0.2, "one_20200601_normal")
    assert (got["st"].limit_ratio, got["st"].is_limit_down, got["st"].limit_rule_reason) == (0.05, True, "risk_warning_limit")
    assert (got["ipo"].has_price_limit, got["ipo"].limit_ratio, got["ipo"].limit_rule_id, got["ipo"].is_limit_up) == (False, None, "one_20200601_ipo_no_limit", False)
    assert got["ipo"].limit_rule_reason == "first_5_trading_days_no_limit"
    assert (got["later_board"].market_board, got["later_board"].limit_ratio) == ("two", 0.3)
    assert got["nolist"].has_price_limit is False  # zero listed days count as new even when the rule has no free days
    assert (got["fallback"].limit_ratio, got["fallback"].limit_rule_id, got["fallback"].is_limit_up) == (0.1, "unknown_default_normal", True)
    assert (got["noprev"].limit_up_price, got["noprev"].is_limit_up) == (None, False)
    assert got["cyb"].market_board == "chinext"


def test_default_boards(spark):
    codes = {"300001.SZ": "chinext", "000001.SZ": "sz_main", "600000.SH": "sh_main", "688001.SH": "star", "830001.BJ": "unknown"}
    df = spark.createDataFrame([(c, None) for c in codes], "ts_code string, market string")
    got = df.select("ts_code", st.market_board("ts_code", "market", st.DEFAULT_LIMIT_RULES).alias("b")).collect()
    assert {r.ts_code: r.b for r in got} == codes


def daily_rows(spark):
    return spark.createDataFrame(
        [("20200103", "10", 10.0, 11.0, 9.0, 10.5, 10.0, 100.0, 1), ("20200103", "10", 10.0, 11.0, 9.0, 10.6, 10.0, 100.0, 2),
         ("20200103", "11", 10.0, 11.0, 9.0, 10.5, 10.0, 0.0, 1), ("20200103", "12", None, 11.0, 9.0, 10.5, 10.0, 5.0, 1), ("20200103", "13", 10.0, 11.0, 9.0, 10.5, 10.0, 5.0, 1)],
        "trade_date string, ts_code string, open double, high double, low double, close double, pre_close double, vol double, at int",
    )


def build(spark):
    basic = spark.createDataFrame([("10", "20200102", None), ("11", "20200102", None), ("12", "20200102", None), ("13", "20200102", None)], "ts_code string, list_date string, market string")
    flagged = spark.createDataFrame([("20200103", "13"), ("20200103", "13")], "trade_date string, ts_code string")
    return st.daily_state(daily_rows(spark), basic, flagged, calendar.open_days(cal(spark)), RULES, "v1", recency=["at"])


def test_daily_state_flags_and_checks(spark):
    state = build(spark)
    got = {r.ts_code: r for r in state.collect()}
    assert len(got) == 4 and state.columns == st.STATE_COLUMNS
    assert [got[c].is_tradable for c in ("10", "11", "12", "13")] == [True, False, False, False]
    assert got["11"].is_suspended and not got["12"].price_valid and got["13"].is_st
    assert all(r.broken_rows == 0 for r in st.state_checks(state).collect())
    broken = state.unionByName(state.where("ts_code = '10'")).withColumn("price_valid", F.lit(False))
    counts = {r.check_name: r.broken_rows for r in st.state_checks(broken).collect()}
    assert counts["duplicate_key"] == 1 and counts["tradable_without_valid_price"] == 2
    totals = st.state_totals(state).first()
    assert (totals.state_rows, totals.st_filtered, totals.invalid_price_rows, totals.suspended_rows) == (4, 1, 1, 1)


def test_state_query_and_coverage(spark):
    state = build(spark)
    rows = st.query_state(state, "v1", "20200101", "20201231", tradable_only=True, columns=["ts_code", "limit_ratio"])
    assert [tuple(r) for r in rows.collect()] == [("10", 0.1)]
    assert st.query_state(state, "v2", "20200101", "20201231").isEmpty()
    assert {r.ts_code for r in st.query_state(state, "v1", "20200101", "20201231", ts_codes=["11", "12"]).collect()} == {"11", "12"}
    dates = spark.createDataFrame([("20200103",), ("20200106",)], "trade_date string")
    with pytest.raises(ValueError):
        st.query_state(state, "v1", "20200101", "20201231", expected_dates=dates)
    report = coverage.coverage_report(dates, state, "v1").first()
    assert (report.expected_trade_dates, report.covered_trade_dates, report.missing_trade_dates, report.coverage_check) == (2, 1, 1, "FAIL")
    assert coverage.coverage_report(dates.limit(1), state, "v1").first().coverage_check == "PASS"


def test_affected_dates(spark):
    raw = spark.createDataFrame([("1", "daily", 5), ("2", "daily", 5), ("3", "daily", 5), ("4", "stock_st", 5), ("2", "stock_st", 9)], "trade_date string, dataset string, modified_time int")
    built = spark.createDataFrame([("1", "v1", 6), ("2", "v1", 6), ("3", "v0", 6)], "trade_date string, state_version string, modified_time int")
    assert sorted(r[0] for r in st.affected_dates(raw, built, "v1").collect()) == ["2", "3"]


def test_audit_latest_value(spark):
    one = coverage.audit_rows(spark.createDataFrame([(1, 2)], "a int, b int"), "v1", "state")
    two = coverage.audit_rows(spark.createDataFrame([(7, 2)], "a int, b int"), "v1", "state").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    view = {r.metric: r.value for r in coverage.audit_view(one.unionByName(two)).collect()}
    assert view == {"a": "7", "b": "2"}
