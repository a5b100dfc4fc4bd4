import os
import time

from tidemark.operators.state import DEFAULT_LIMIT_RULES
from tidemark.plans import runs
from tidemark.sources import ingest
from tidemark.sources.schemas import DATASETS

HEAD = "ts_code,trade_date,open,high,low,close,pre_close,change,pct_chg,vol,amount,vwap"


def write_day(root, day, closes):
    os.makedirs(f"{root}/daily", exist_ok=True)
    with open(f"{root}/daily/{day}.csv", "w") as f:
        f.write(HEAD + "\n" + "".join(f"{code},{day},1,2,1,{close},1,0,0,5,5,1\n" for code, close in closes.items()))


def test_state_is_built_for_changed_dates_only(spark, tmp_path):
    source, raw, registry, path = (str(tmp_path / n) for n in ("source", "raw", "registry", "state"))
    basic = spark.createDataFrame([("600001.SH", "M", "20190101")], "ts_code string, market string, list_date string")

    def run():
        ingest.ingest_all(spark, source, raw, registry, [DATASETS["daily"]])
        dates = runs.update_state(spark, raw, ingest.read_registry(spark, registry), path, basic, None, DEFAULT_LIMIT_RULES, "v1")
        rows = spark.read.parquet(path).collect()
        return sorted(r[0] for r in dates.collect()), {(str(r["trade_date"]), r["ts_code"]): (r["is_limit_up"], r["created_at"]) for r in rows}

    write_day(source, "20200102", {"600001.SH": 1.0})
    write_day(source, "20200103", {"600001.SH": 1.0, "600002.SH": 1.0})
    dates, first = run()
    assert dates == ["20200102", "20200103"] and len(first) == 3
    time.sleep(1.1)
    assert run() == ([], first)
    write_day(source, "20200103", {"600001.SH": 1.1})
    time.sleep(1.1)
    dates, second = run()
    assert dates == ["20200103"] and len(second) == 2
    assert second["20200102", "600001.SH"] == first["20200102", "600001.SH"]
    assert second["20200103", "600001.SH"][0] and not first["20200103", "600001.SH"][0]


def test_pool_is_rebuilt_for_new_files_only(spark, tmp_path):
    processed, pool = str(tmp_path / "processed"), str(tmp_path / "pool")
    fields = "dataset string, status string, filename string, raw_path string, source_path string, md5 string"
    rows = [("index_weight", "ingested", "X_1.csv", "/r", "/s/X_1.csv", "m1"), ("index_weight", "ingested", "Y_1.csv", "/r", "/s/Y_1.csv", "m9")]
    raw = spark.createDataFrame([("X", "A", "20200101", "1"), ("X", "B", "20200201", "1")], "index_code string, con_code string, trade_date string, weight string")

    def run(registry_rows):
        return runs.update_pool(spark, raw, spark.createDataFrame(registry_rows, fields), processed, pool, "X", "v1")

    assert run(rows) and not run(rows)
    assert spark.read.parquet(pool).count() == 2
    assert run([(*rows[0][:5], "m2"), rows[1]]) and not run([(*rows[0][:5], "m2"), rows[1]])
    assert run([*rows, ("index_weight", "ingested", "X_2.csv", "/r", "/s/X_2.csv", "m3")])


def test_audit_log_keeps_the_latest_value(spark, tmp_path):
    path = str(tmp_path / "audit")
    for n in (1, 2):
        runs.append_audit(spark.createDataFrame([(n, "x")], "rows long, note string"), "v1", "state", path)
        time.sleep(0.01)
    assert {(r["metric"], r["value"]) for r in runs.read_audit(spark, path).collect()} == {("rows", "2"), ("note", "x")}
