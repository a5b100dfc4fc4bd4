import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state as st
from tidemark.session import stage
from tidemark.sources import ingest, tables
from tidemark.sources.schemas import DATASETS
from tidemark.streaming import incremental

DAILY_HEADER = "ts_code,open,high,low,close,pre_close,change,pct_chg,vol,amount,vwap"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def daily(close, code="000001.SZ"):
    return f"{DAILY_HEADER}\n{code},1,2,0.5,{close},1,0,0,100,1000,1\n"


@pytest.fixture
def lake(tmp_path):
    source = str(tmp_path / "源 data+1%")
    put(f"{source}/daily/20200101.csv", daily(1.5))
    put(f"{source}/daily/20200102.csv", daily(1.6))
    # another column order, an extra column, missing values
    put(f"{source}/daily/20200103.csv", "close,ts_code,open,high,low,pre_close,change,pct_chg,vol,amount,vwap,note\n1.7,000002.SZ,NA,2,,1,0,0,100,1000,1,x\n")
    put(f"{source}/trade_cal.csv", "exchange,cal_date,is_open,pretrade_date\nS,20200101,1.0,20191231\nS,20200102,0,20200101.0\n")
    put(f"{source}/market/399006.SZ.csv", "ts_code,trade_date,close,open,high,low,pre_close,change,pct_chg,vol,amount\n399006.SZ,20200101,10,9,11,8,9,1,1,5,50\n")
    return source, str(tmp_path / "raw"), str(tmp_path / "registry")


def registry(spark, lake):
    return ingest.read_registry(spark, lake[2])


def test_ingest_lifecycle(spark, lake):
    source, raw, reg = lake
    assert registry(spark, lake).isEmpty()
    plan = ingest.ingest_all(spark, source, raw, reg, dry_run=True)
    assert plan.count() == 5 and {r.status for r in plan.collect()} == {"dry_run"} and registry(spark, lake).isEmpty()

    first = ingest.ingest_all(spark, source, raw, reg)
    by_name = {r.filename: r for r in first.collect()}
    assert set(by_name) == {"20200101.csv", "20200102.csv", "20200103.csv", "trade_cal.csv", "399006.SZ.csv"}
    assert (by_name["20200103.csv"].trade_date_min, by_name["20200103.csv"].row_count) == ("20200103", 1)
    assert (by_name["trade_cal.csv"].trade_date_min, by_name["trade_cal.csv"].trade_date_max) == ("20200101", "20200102")
    assert ingest.latest_version(first).first()[0] == "v20200103"

    rows = {r.trade_date: r for r in ingest.read_raw(spark, raw, registry(spark, lake), "daily").collect()}
    assert (rows["20200101"].close, rows["20200103"].close, rows["20200103"].open, rows["20200103"].low) == (1.5, 1.7, None, None)
    assert rows["20200101"].ts_code == "000001.SZ"
    cal = ingest.read_raw(spark, raw, registry(spark, lake), "trade_cal").orderBy("cal_date").collect()
    assert [(r.is_open, r.pretrade_date) for r in cal] == [(1, "20191231"), (0, "20200101")]
    assert ingest.read_raw(spark, raw, registry(spark, lake), "market").first().ts_code == "399006.SZ"

    assert ingest.ingest_all(spark, source, raw, reg).isEmpty()  # nothing changed

    before = stage(registry(spark, lake), "before")
    put(f"{source}/daily/20200102.csv", daily(9.9) + "000003.SZ,1,2,0.5,3,1,0,0,100,1000,1\n")
    put(f"{source}/daily/20200104.csv", daily(2.0))
    second = ingest.ingest_all(spark, source, raw, reg)
    summary = ingest.run_summary(second, before)
    s = summary.first()
    assert (s.files, s.new_files, s.modified_files, s.new_trade_dates, s.ingested_rows) == (2, 1, 1, 2, 3)
    now = ingest.read_raw(spark, raw, registry(spark, lake), "daily")
    assert sorted((r.trade_date, r.close) for r in now.collect()) == [("20200101", 1.5), ("20200102", 3.0), ("20200102", 9.9), ("20200103", 1.7), ("20200104", 2.0)]


def test_bad_values_stop_the_run_and_unregistered_rows_stay_hidden(spark, lake):
    source, raw, reg = lake
    put(f"{source}/daily/20200105.csv", daily("oops"))
    with pytest.raises(ValueError, match="oops"):
        ingest.ingest_all(spark, source, raw, reg, [DATASETS["daily"]])
    assert registry(spark, lake).isEmpty()
    put(f"{source}/daily/20200105.csv", daily(3.0))
    ingest.ingest_all(spark, source, raw, reg, [DATASETS["daily"]])
    # a run that wrote rows but died before it registered them
    orphan = spark.read.parquet(f"{raw}/daily").withColumn("_run_id", F.lit("dead"))
    orphan.write.mode("append").partitionBy("trade_date").parquet(f"{raw}/daily")
    assert ingest.read_raw(spark, raw, registry(spark, lake), "daily").count() == 4


def test_missing_and_extra_columns():
    expected = {"a": "string", "b": "numeric"}
    with pytest.raises(ValueError, match="missing"):
        ingest.check_columns(["a"], expected, "f")
    ingest.check_columns(["a", "b", "c"], expected, "f")
    with pytest.raises(ValueError, match="unexpected"):
        ingest.check_columns(["a", "b", "c"], expected, "f", strict=True)


def test_violations_by_type(spark):
    df = spark.createDataFrame(
        [("f", "1.5", "2.0", "20200101.0"), ("f", "x", "2.5", "2020-01-01"), ("f", None, "y", None)], "source_path string, n string, i string, d string"
    )
    got = {(r.column_name, r.value) for r in ingest.violations(df, {"n": "numeric", "i": "integer", "d": "date_yyyymmdd"}).collect()}
    assert got == {("n", "x"), ("i", "2.5"), ("i", "y"), ("d", "2020-01-01")}
    many = spark.range(20).select(F.lit("f").alias("source_path"), F.concat(F.lit("v"), F.format_string("%02d", "id")).alias("n"))
    assert [r.value for r in ingest.violations(many, {"n": "numeric"}).orderBy("place").collect()] == ["v00", "v01", "v02", "v03", "v04"]
    with pytest.raises(ValueError):
        ingest.violations(df, {"n": "money"})


def test_changes_and_samples(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_path string, md5 string")
    known = spark.createDataFrame([("a", "0", 1), ("a", "1", 2), ("b", "2", 1), ("b", "9", 2)], "source_path string, md5 string, last_ingest_time int")
    assert {r.source_path: r.change for r in ingest.changes(found, known).collect()} == {"b": "modified", "c": "new"}
    files = found.withColumn("dataset", F.lit("d"))
    assert [r.source_path for r in ingest.sample_files(files, 1).collect()] == ["a"] and ingest.sample_files(files, -1).count() == 3


def test_registry_fills_missing_columns(spark, tmp_path):
    path = str(tmp_path / "reg")
    spark.createDataFrame([("daily", "/x")], "dataset string, source_path string").write.parquet(path)
    row = ingest.read_registry(spark, path).first()
    assert (row.dataset, row.md5) == ("daily", None)


def test_versions_log(spark, tmp_path):
    path = str(tmp_path / "versions")
    summary = spark.createDataFrame([(1, 2, 0)], "new_trade_dates long, new_files long, modified_files long")
    ingest.append_version(summary, "v1", path)
    ingest.append_version(summary, "v2", path)
    assert sorted(r.data_version for r in spark.read.parquet(path).collect()) == ["v1", "v2"]


def test_state_partitions_are_replaced_by_date(spark, tmp_path):
    path = str(tmp_path / "state")
    make = lambda d, v: spark.createDataFrame([(d, "a", v), (d, "b", v)], "trade_date string, ts_code string, state_version string")
    tables.replace_dates(make("20200101", "v1").unionByName(make("20200102", "v1")), path)
    tables.replace_dates(make("20200102", "v2").limit(1), path)
    got = sorted((r.trade_date, r.state_version) for r in tables.read_dates(spark, path, "20200101", "20200102", ["trade_date", "state_version"]).collect())
    assert got == [("20200101", "v1"), ("20200101", "v1"), ("20200102", "v2")]
    assert sorted(r[0] for r in tables.partition_dates(spark, path).collect()) == ["20200101", "20200102"]
    raw = str(tmp_path / "raw")
    time.sleep(1.1)
    spark.createDataFrame([("20200101", 1), ("20200103", 1)], "trade_date string, x int").write.partitionBy("trade_date").parquet(f"{raw}/daily")
    stale = st.affected_dates(ingest.raw_files(spark, raw, "daily"), tables.state_files(spark, path), "v1")
    assert sorted(r[0] for r in stale.collect()) == ["20200101", "20200103"]
    plan = tables.read_dates(spark, path, "20200102", "20200102")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "20200102" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pool_sink_refuses_overwrite(spark, tmp_path):
    path = str(tmp_path / "pool")
    df = spark.createDataFrame([(1,)], "a int")
    tables.write_pool(df, path)
    with pytest.raises(Exception):
        tables.write_pool(df, path)
    tables.write_pool(df, path, overwrite=True)
    tables.write_report(df, str(tmp_path / "csv"), csv=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().a == "1"


def test_streaming_ingest_takes_only_new_files(spark, lake, tmp_path):
    source, raw, reg = lake
    run = lambda: incremental.ingest_new_files(spark, source, DATASETS["daily"], raw, reg, str(tmp_path / "cp"))
    run()
    assert registry(spark, lake).count() == 3
    put(f"{source}/daily/20200106.csv", daily(4.0))
    run()
    assert registry(spark, lake).count() == 4
    assert ingest.read_raw(spark, raw, registry(spark, lake), "daily").count() == 4
    assert ingest.ingest_all(spark, source, raw, reg, [DATASETS["daily"]]).isEmpty()


@pytest.mark.parametrize("check_content", [True, False])
def test_revisions_of_equal_length(spark, lake, check_content):
    """Revised within the second, and revised with the old time put back, as copying tools do."""
    source, raw, reg = lake
    names = [f"{source}/daily/2020010{d}.csv" for d in (1, 2, 3)]
    for name in names:
        put(name, daily(1.5))
        os.utime(name, (1.6e9, 1.6e9))
    soon = time.time() + 600
    os.utime(names[0], (soon, soon))  # not older than its registration
    run = lambda: ingest.ingest_all(spark, source, raw, reg, [DATASETS["daily"]], check_content=check_content)
    assert run().count() == 3
    put(names[0], daily(2.5))
    os.utime(names[0], (soon, soon))  # the same time, but it was registered no later: read again
    put(names[1], daily(3.5))
    os.utime(names[1], (1.6e9, 1.6e9))  # an old file with its time put back: only its content tells
    assert {r["filename"] for r in run().collect()} == {"20200101.csv", *(["20200102.csv"] if check_content else [])}
    seen = {r["trade_date"]: r["close"] for r in ingest.read_raw(spark, raw, registry(spark, lake), "daily").collect()}
    assert seen == {"20200101": 2.5, "20200102": 3.5 if check_content else 1.5, "20200103": 1.5}
    os.utime(names[2], (1.6e9, 1.6e9 + 0.25))  # only a fraction of a second apart, same content
    assert run().isEmpty()
