"""Every registered query: the Spark plan and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.scalars import grid, grid_sql
from tidemark.operators import calendar, coverage, datasets, factors, features, labels, membership, regimes, selection, state
from tidemark.operators.features import KEYS
from tidemark.operators.panel import latest
from tidemark.plans import mart, oracle, reports, testbed as tb
from tidemark.plans.oracle import E, avg_rank, div, grid as sgrid, growth, lag, pct_rank, roll, with_ctes
from tidemark.session import MAX_CUTS_KEY, ROWS_PER_BUCKET_KEY, run_folder
from tidemark.sources import ingest
from tidemark.sources.schemas import DATASETS

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

LABEL = labels.LABEL
FEATURES = tb.REPORT_FEATURES
MIN_CS = 30


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return fn

    return register


def report(df: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = 6, wide: Sequence[str] = ()) -> DataFrame:
    """Keys plus values on a comparison grid; ``wide`` names values of large magnitude."""
    return df.selectExpr(*keys, *[f"{grid_sql(v, 2 if v in wide else digits)} AS `{v}`" for v in values])


def sreport(source: str, keys: Sequence[str], values: Sequence[str], digits: int = 6, wide: Sequence[str] = (), where: str = "") -> str:
    cells = [f"{sgrid(v, 2 if v in wide else digits)} AS {v}" for v in values]
    return f"SELECT {', '.join([*keys, *cells])} FROM {source} {where}"


# --- raw tables and joins ---------------------------------------------------------------------------

query("bars", "SELECT trade_date, ts_code, open, high, low, close, pre_close, vol, amount FROM wide")(tb.daily)


@query(
    "panel_join",
    "SELECT trade_date, ts_code, close, turnover_rate, volume_ratio, pe_ttm, pb, total_mv, circ_mv, net_mf_amount, "
    "buy_lg_amount, sell_lg_amount, industry, market, list_date FROM base_panel",
)
def panel_join(spark, folder):
    panel = mart.base_panel(
        tb.daily(spark, folder), tb.metric(spark, folder), tb.moneyflow(spark, folder), tb.basic(spark, folder), tb.FIRST, tb.LAST
    )
    return panel.select(
        *KEYS, "close", "turnover_rate", "volume_ratio", "pe_ttm", "pb", "total_mv", "circ_mv", "net_mf_amount",
        "buy_lg_amount", "sell_lg_amount", "industry", "market", "list_date",
    )


# --- ingest -----------------------------------------------------------------------------------------

# the order table read as text: one good column per rule and one that breaks it
ORDER_SCHEMA = {
    "o_orderkey": "integer", "o_totalprice": "integer", "o_custkey": "numeric", "o_orderpriority": "numeric",
    "o_orderdate": "date_yyyymmdd", "o_orderday": "date_yyyymmdd", "o_orderstatus": "string",
}


def _order_text(spark: SparkSession, folder: str) -> DataFrame:
    o = tb.table(spark, folder, "orders")
    return o.select(
        F.concat(F.lit("orders/"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".csv")).alias("source_path"),
        *[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")],
        F.format_string("%.2f", "o_totalprice").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("o_orderday"),
    )


oracle.CTES["order_files"] = "SELECT *, 'orders/' || strftime(o_orderdate, '%Y%m') || '.csv' AS source_path FROM orders"
oracle.CTES["bad_values"] = (
    "SELECT source_path, 'o_totalprice' AS column_name, 'integer' AS expected_type, printf('%.2f', o_totalprice) AS value "
    "FROM order_files WHERE CAST(printf('%.2f', o_totalprice) AS DOUBLE) % 1 <> 0 "
    "UNION ALL SELECT source_path, 'o_orderpriority', 'numeric', o_orderpriority FROM order_files "
    "UNION ALL SELECT source_path, 'o_orderdate', 'date_yyyymmdd', strftime(o_orderdate, '%Y-%m-%d') FROM order_files"
)


@query(
    "schema_violations",
    "SELECT source_path, column_name, expected_type, value, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER "
    "(PARTITION BY source_path, column_name ORDER BY value) AS place FROM bad_values) WHERE place <= 5",
)
def schema_violations(spark, folder):
    return ingest.violations(_order_text(spark, folder), ORDER_SCHEMA, per_column=5)


@query(
    "typed_columns",
    "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS priority, "
    "strftime(o_orderdate, '%Y%m%d') AS day FROM orders",
)
def typed_columns(spark, folder):
    schema = {"o_orderkey": "integer", "o_totalprice": "numeric", "o_orderpriority": "numeric", "o_orderday": "date_yyyymmdd"}
    typed = ingest.enforce_types(_order_text(spark, folder), schema)
    return typed.select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderday").alias("day")
    )


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as files: the last turn is the file as found, the turns before are its history."""
    turns = tb.table(spark, folder, "conversations").select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("source_path"),
        F.md5("text").alias("md5"),
        F.col("turn").alias("last_ingest_time"),
    )
    last = turns.groupBy("source_path").agg(F.max("last_ingest_time").alias("last_turn"))
    both = turns.join(last, "source_path")
    found = both.where("last_ingest_time = last_turn").select("source_path", "md5")
    known = both.where("last_ingest_time < last_turn").select("source_path", "md5", "last_ingest_time")
    return found, known


_TURNS = (
    "(SELECT 'conv/' || conv_id AS source_path, md5(text) AS md5, turn, max(turn) OVER (PARTITION BY conv_id) AS last_turn "
    "FROM conversations)"
)
_KNOWN = f"(SELECT source_path, arg_max(md5, turn) AS md5, max(turn) AS last_ingest_time FROM {_TURNS} WHERE turn < last_turn GROUP BY 1)"
_CHANGES = (
    f"SELECT f.source_path, CASE WHEN k.md5 IS NULL THEN 'new' ELSE 'modified' END AS change, f.md5 "
    f"FROM (SELECT * FROM {_TURNS} WHERE turn = last_turn) f LEFT JOIN {_KNOWN} k ON k.source_path = f.source_path "
    f"WHERE k.md5 IS NULL OR k.md5 <> f.md5"
)


@query("registry_latest", f"SELECT source_path, md5, last_ingest_time FROM {_KNOWN}")
def registry_latest(spark, folder):
    return latest(_versions(spark, folder)[1], ["source_path"], ["last_ingest_time"])


@query("change_detection", _CHANGES)
def change_detection(spark, folder):
    found, known = _versions(spark, folder)
    return ingest.changes(found, known).select("source_path", "change", "md5")


@query("change_counts", f"SELECT change, count(*) AS files FROM ({_CHANGES}) GROUP BY 1")
def change_counts(spark, folder):
    return change_detection(spark, folder).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


@query(
    "file_bounds",
    f"SELECT source_path, count(*) AS row_count, min(d) AS trade_date_min, max(d) AS trade_date_max "
    f"FROM (SELECT source_path, strftime(o_orderdate, '%Y%m%d') AS d FROM order_files) GROUP BY 1",
)
def file_bounds(spark, folder):
    return ingest.file_bounds(_order_text(spark, folder), "o_orderday")


@query(
    "data_version",
    f"SELECT 'v' || max(strftime(o_orderdate, '%Y%m%d')) AS data_version FROM orders",
)
def data_version(spark, folder):
    return ingest.latest_version(file_bounds(spark, folder))


def _ingested(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The membership snapshots written as CSV files, ingested, and read back: (raw rows, registry)."""
    root = f"{run_folder(spark)}/lake-{uuid.uuid4().hex}"
    tb.index_weight(spark, folder).write.option("header", True).csv(f"{root}/source/index_weight")
    ingest.ingest_all(spark, f"{root}/source", f"{root}/raw", f"{root}/registry", [DATASETS["index_weight"]])
    registry = ingest.read_registry(spark, f"{root}/registry")
    return ingest.read_raw(spark, f"{root}/raw", registry, "index_weight"), registry


@query("ingest_raw", "SELECT index_code, ts_code AS con_code, trade_date, index_weight AS weight FROM snapshots")
def ingest_raw(spark, folder):
    return _ingested(spark, folder)[0].select("index_code", "con_code", "trade_date", "weight")


@query(
    "ingest_registry",
    "SELECT 'index_weight' AS dataset, 'ingested' AS status, CAST(count(*) AS BIGINT) AS row_count, min(trade_date) AS trade_date_min, "
    "max(trade_date) AS trade_date_max FROM snapshots",
)
def ingest_registry(spark, folder):
    registry = _ingested(spark, folder)[1]
    return registry.groupBy("dataset", "status").agg(
        F.sum("row_count").alias("row_count"), F.min("trade_date_min").alias("trade_date_min"), F.max("trade_date_max").alias("trade_date_max")
    )


# --- membership -------------------------------------------------------------------------------------


@query("scd2_intervals", "SELECT index_code, ts_code, effective_from, effective_to, index_weight, source_trade_date, is_active FROM intervals")
def scd2_intervals(spark, folder):
    return tb.intervals(spark, folder).drop("pool_version", "created_at")


@query(
    "scd2_enriched",
    "SELECT i.ts_code, i.index_code, effective_from, effective_to, index_weight, name, industry, market, list_date, is_active "
    "FROM intervals i LEFT JOIN basic b ON b.ts_code = i.ts_code",
)
def scd2_enriched(spark, folder):
    full = membership.enrich_intervals(tb.intervals(spark, folder), tb.basic(spark, folder))
    return full.drop("source_trade_date", "pool_version", "created_at")


@query(
    "scd2_metrics",
    "SELECT count(*) AS pool_intervals, count(*) FILTER (is_active) AS pool_active_intervals, "
    "count(*) FILTER (NOT is_active) AS pool_closed_intervals, count(DISTINCT ts_code) AS pool_unique_stocks FROM intervals",
)
def scd2_metrics(spark, folder):
    return membership.interval_metrics(tb.intervals(spark, folder))


@query(
    "scd2_violations",
    "SELECT index_code, ts_code, effective_from, effective_to, previous_to, CASE WHEN effective_from > effective_to THEN "
    "'starts_after_end' ELSE 'overlap' END AS violation FROM (SELECT *, lag(effective_to) OVER (PARTITION BY index_code, ts_code "
    "ORDER BY effective_from, effective_to) AS previous_to FROM (SELECT o_orderstatus AS index_code, CAST(o_custkey AS VARCHAR) AS "
    "ts_code, strftime(o_orderdate, '%Y%m%d') AS effective_from, strftime(o_orderdate + INTERVAL 60 DAY, '%Y%m%d') AS effective_to "
    "FROM orders)) WHERE effective_from > effective_to OR effective_from <= previous_to",
)
def scd2_violations(spark, folder):
    """Sixty-day intervals opened by each order of a customer: real overlaps."""
    spans = tb.table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("index_code"),
        F.col("o_custkey").cast("string").alias("ts_code"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("effective_from"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 60), "yyyyMMdd").alias("effective_to"),
    )
    return membership.interval_violations(spans)


@query(
    "interval_semi",
    "SELECT p.trade_date, p.ts_code, p.close, p.amount FROM wide p WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.ts_code = p.ts_code "
    "AND p.trade_date BETWEEN i.effective_from AND i.effective_to)",
)
def interval_semi(spark, folder):
    rows = tb.daily(spark, folder).select(*KEYS, "close", "amount")
    return membership.members_only(rows, tb.intervals(spark, folder))


@query(
    "overlap_prefilter",
    "SELECT ts_code, effective_from, effective_to FROM intervals WHERE effective_from <= '19971231' AND effective_to >= '19970601'",
)
def overlap_prefilter(spark, folder):
    return membership.intervals_touching(tb.intervals(spark, folder), "19970601", "19971231")


# --- calendar and state -----------------------------------------------------------------------------

query("calendar_index", "SELECT cal_date, trade_index FROM open_days")(
    lambda spark, folder: calendar.open_days(tb.trade_calendar(spark, folder)).withColumn("trade_index", F.col("trade_index").cast("long"))
)


@query("listed_days", "SELECT trade_date, ts_code, list_date, listed_days FROM listed")
def listed_days(spark, folder):
    rows = tb.panel(spark, folder).select(*KEYS, "list_date")
    return calendar.with_listed_days(rows, calendar.open_days(tb.trade_calendar(spark, folder)))


@query(
    "board_rules",
    "SELECT trade_date, ts_code, market_board, reform_from, normal_ratio, st_ratio, ipo_days FROM ruled",
)
def board_rules(spark, folder):
    rows = tb.panel(spark, folder).select(*KEYS, "market").withColumn(
        "market_board", state.market_board("ts_code", "market", tb.LIMIT_RULES)
    )
    return state.with_active_rule(rows, tb.LIMIT_RULES).drop("market")


_STATE_OUT = [c for c in state.STATE_COLUMNS if c != "created_at"]


@query("daily_state", f"SELECT {', '.join(_STATE_OUT)} FROM state")
def daily_state(spark, folder):
    return tb.build_state(spark, folder).select(*_STATE_OUT)


@query(
    "state_checks",
    "SELECT 'duplicate_key' AS check_name, (SELECT count(*) FROM state) - (SELECT count(*) FROM (SELECT DISTINCT trade_date, ts_code FROM "
    "state)) AS broken_rows UNION ALL SELECT 'null_tradable', count(*) FILTER (is_tradable IS NULL) FROM state UNION ALL "
    "SELECT 'negative_listed_days', count(*) FILTER (listed_days < 0) FROM state UNION ALL "
    "SELECT 'negative_listed_trading_days', count(*) FILTER (listed_trading_days < 0) FROM state UNION ALL "
    "SELECT 'tradable_without_valid_price', count(*) FILTER (is_tradable AND NOT price_valid) FROM state UNION ALL "
    "SELECT 'tradable_without_valid_volume', count(*) FILTER (is_tradable AND NOT volume_valid) FROM state UNION ALL "
    "SELECT 'limit_hit_without_limit', count(*) FILTER (NOT has_price_limit AND (is_limit_up OR is_limit_down)) FROM state UNION ALL "
    "SELECT 'limited_without_limit_price', count(*) FILTER (has_price_limit AND price_valid AND (limit_up_price IS NULL OR "
    "limit_down_price IS NULL)) FROM state",
)
def state_checks(spark, folder):
    return state.state_checks(tb.state(spark, folder))


_D = "substr(ts_code, 6, 1)"
_M = "substr(trade_date, 5, 2)"
_BROKEN = (
    f"SELECT * REPLACE (CASE WHEN {_M} = '03' AND {_D} = '7' THEN NULL ELSE is_tradable END AS is_tradable, "
    f"CASE WHEN {_M} = '05' AND {_D} = '3' THEN false ELSE price_valid END AS price_valid, "
    f"CASE WHEN {_M} = '06' AND {_D} = '4' THEN false ELSE volume_valid END AS volume_valid, "
    f"CASE WHEN {_M} = '07' AND {_D} = '1' THEN -1 ELSE listed_days END AS listed_days, "
    f"CASE WHEN {_M} = '08' AND {_D} = '2' THEN -5 ELSE listed_trading_days END AS listed_trading_days, "
    f"CASE WHEN {_D} = '5' THEN false ELSE has_price_limit END AS has_price_limit, "
    f"CASE WHEN {_M} = '10' AND {_D} = '6' THEN NULL ELSE limit_up_price END AS limit_up_price) FROM state "
    f"UNION ALL SELECT * FROM state WHERE {_M} = '11' AND {_D} = '9'"
)


def _broken_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state with some rows spoiled in every way the checks look for."""
    whole = tb.state(spark, folder)
    month, digit = F.substring("trade_date", 5, 2), F.substring("ts_code", 6, 1)
    spoiled = {
        "is_tradable": ((month == "03") & (digit == "7"), None),
        "price_valid": ((month == "05") & (digit == "3"), False),
        "volume_valid": ((month == "06") & (digit == "4"), False),
        "listed_days": ((month == "07") & (digit == "1"), -1),
        "listed_trading_days": ((month == "08") & (digit == "2"), -5),
        "has_price_limit": (digit == "5", False),
        "limit_up_price": ((month == "10") & (digit == "6"), None),
    }
    changed = whole.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, (hit, v) in spoiled.items()})
    return changed.unionByName(whole.where((month == "11") & (digit == "9")))


_CHECKS_SQL = (
    "SELECT 'duplicate_key' AS check_name, (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT trade_date, ts_code FROM {t})) AS broken_rows "
    "UNION ALL SELECT 'null_tradable', count(*) FILTER (is_tradable IS NULL) FROM {t} UNION ALL SELECT 'negative_listed_days', count(*) FILTER (listed_days < 0) FROM {t} "
    "UNION ALL SELECT 'negative_listed_trading_days', count(*) FILTER (listed_trading_days < 0) FROM {t} "
    "UNION ALL SELECT 'tradable_without_valid_price', count(*) FILTER (is_tradable AND NOT price_valid) FROM {t} "
    "UNION ALL SELECT 'tradable_without_valid_volume', count(*) FILTER (is_tradable AND NOT volume_valid) FROM {t} "
    "UNION ALL SELECT 'limit_hit_without_limit', count(*) FILTER (NOT has_price_limit AND (is_limit_up OR is_limit_down)) FROM {t} "
    "UNION ALL SELECT 'limited_without_limit_price', count(*) FILTER (has_price_limit AND price_valid AND (limit_up_price IS NULL OR limit_down_price IS NULL)) FROM {t}"
)


@query("state_checks_broken", _CHECKS_SQL.format(t=f"({_BROKEN})"))
def state_checks_broken(spark, folder):
    return state.state_checks(_broken_state(spark, folder))


@query(
    "state_totals",
    "SELECT count(*) AS state_rows, count(*) FILTER (is_st) AS st_filtered, count(*) FILTER (NOT price_valid) AS invalid_price_rows, "
    "count(*) FILTER (is_suspended) AS suspended_rows, count(DISTINCT trade_date) AS trade_dates FROM state",
)
def state_totals(spark, folder):
    return state.state_totals(tb.state(spark, folder))


@query(
    "state_query",
    "SELECT s.trade_date, s.ts_code, s.market_board, s.limit_ratio, s.limit_up_price FROM state s WHERE is_tradable AND "
    "s.trade_date BETWEEN '19960101' AND '19991231' AND EXISTS (SELECT 1 FROM intervals i WHERE i.ts_code = s.ts_code AND "
    "s.trade_date BETWEEN i.effective_from AND i.effective_to)",
)
def state_query(spark, folder):
    return state.query_state(
        tb.state(spark, folder), tb.STATE_VERSION, "19960101", "19991231", tradable_only=True, require_price_valid=True,
        require_volume_valid=True, pool=tb.intervals(spark, folder),
        columns=["trade_date", "ts_code", "market_board", "limit_ratio", "limit_up_price"],
        expected_dates=tb.daily(spark, folder).select("trade_date"),
    )


@query(
    "state_query_summary",
    "SELECT count(*) AS rows, count(DISTINCT trade_date) AS trade_dates, count(DISTINCT ts_code) AS ts_codes FROM state WHERE is_tradable",
)
def state_query_summary(spark, folder):
    rows = state.query_state(tb.state(spark, folder), tb.STATE_VERSION, tb.FIRST, tb.LAST, tradable_only=True)
    return state.query_summary(rows)


_ORDER_DAYS = "(SELECT DISTINCT strftime(o_orderdate, '%Y%m') || '01' AS trade_date FROM orders)"
_SHIP_DAYS = "(SELECT DISTINCT strftime(l_shipdate, '%Y%m') || '01' AS trade_date FROM lineitem)"


@query(
    "coverage",
    f"SELECT e.n AS expected_trade_dates, c.n AS covered_trade_dates, e.n - c.n AS missing_trade_dates, s.n - c.n AS extra_trade_dates, "
    f"CAST(0 AS BIGINT) AS broken_rows, CASE WHEN e.n = c.n THEN 'PASS' ELSE 'FAIL' END AS coverage_check "
    f"FROM (SELECT count(*) AS n FROM {_ORDER_DAYS}) e, (SELECT count(*) AS n FROM {_SHIP_DAYS}) s, "
    f"(SELECT count(*) AS n FROM (SELECT * FROM {_ORDER_DAYS} INTERSECT SELECT * FROM {_SHIP_DAYS})) c",
)
def coverage_query(spark, folder):
    """Months with orders against months with state rows."""
    expected = tb.table(spark, folder, "orders").select(
        F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("01")).alias("trade_date")
    )
    return coverage.coverage_report(expected, tb.state(spark, folder), tb.STATE_VERSION)


_COVERED = f"(SELECT * FROM {_ORDER_DAYS} INTERSECT SELECT * FROM {_SHIP_DAYS})"


@query(
    "coverage_broken",
    f"SELECT e.n AS expected_trade_dates, c.n AS covered_trade_dates, e.n - c.n AS missing_trade_dates, s.n - c.n AS extra_trade_dates, "
    f"b.n AS broken_rows, CASE WHEN e.n = c.n AND b.n = 0 THEN 'PASS' ELSE 'FAIL' END AS coverage_check "
    f"FROM (SELECT count(*) AS n FROM {_ORDER_DAYS}) e, (SELECT count(*) AS n FROM {_SHIP_DAYS}) s, (SELECT count(*) AS n FROM {_COVERED}) c, "
    f"(SELECT CAST(sum(broken_rows) AS BIGINT) AS n FROM ("
    + _CHECKS_SQL.format(t=f"(SELECT * FROM ({_BROKEN}) WHERE trade_date IN {_COVERED})")
    + ") WHERE check_name IN ('duplicate_key', 'null_tradable', 'tradable_without_valid_price', 'tradable_without_valid_volume')) b",
)
def coverage_broken(spark, folder):
    """Coverage of a state that has broken rows on dates in the middle."""
    expected = tb.table(spark, folder, "orders").select(
        F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("01")).alias("trade_date")
    )
    return coverage.coverage_report(expected, _broken_state(spark, folder), tb.STATE_VERSION)


@query(
    "date_gaps",
    f"SELECT trade_date, 'missing' AS side FROM (SELECT * FROM {_ORDER_DAYS} EXCEPT SELECT * FROM {_SHIP_DAYS}) UNION ALL "
    f"SELECT trade_date, 'extra' FROM (SELECT * FROM {_SHIP_DAYS} EXCEPT SELECT * FROM {_ORDER_DAYS})",
)
def date_gaps(spark, folder):
    ordered = tb.table(spark, folder, "orders").select(
        F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("01")).alias("trade_date")
    )
    built = tb.state(spark, folder)
    return coverage.missing_dates(ordered, built).withColumn("side", F.lit("missing")).unionByName(
        coverage.extra_dates(ordered, built).withColumn("side", F.lit("extra"))
    )


@query(
    "affected_dates",
    "SELECT r.trade_date FROM (SELECT strftime(o_orderdate, '%Y%m') AS trade_date, max(o_orderdate) AS raw_time, "
    "count(*) FILTER (o_orderstatus = 'O') AS daily_files FROM orders GROUP BY 1) r LEFT JOIN (SELECT strftime(l_shipdate, '%Y%m') AS "
    "trade_date, max(l_shipdate) AS state_time, count(*) FILTER (l_linestatus = 'F') AS own FROM lineitem GROUP BY 1) s "
    "ON s.trade_date = r.trade_date WHERE daily_files > 0 AND (own IS NULL OR own = 0 OR raw_time > state_time)",
)
def affected_dates(spark, folder):
    """Orders as raw files (status O = the daily set), line items as state files of two versions."""
    raw = tb.table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyyMM").alias("trade_date"),
        F.when(F.col("o_orderstatus") == "O", "daily").otherwise("stock_st").alias("dataset"),
        F.col("o_orderdate").alias("modified_time"),
    )
    built = tb.table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "yyyyMM").alias("trade_date"),
        F.col("l_linestatus").alias("state_version"),
        F.col("l_shipdate").alias("modified_time"),
    )
    return state.affected_dates(raw, built, "F")


_EARLIER = "CASE WHEN month(l_shipdate) % 2 = 0 THEN l_shipdate - INTERVAL 5 DAY ELSE l_shipdate END"


@query(
    "affected_dates_stale",
    "SELECT r.trade_date FROM (SELECT strftime(o_orderdate, '%Y%m') AS trade_date, max(o_orderdate) AS raw_time, "
    "count(*) FILTER (o_orderstatus = 'O') AS daily_files FROM orders GROUP BY 1) r LEFT JOIN (SELECT strftime(l_shipdate, '%Y%m') AS "
    f"trade_date, max({_EARLIER}) AS state_time, count(*) FILTER (l_linestatus = 'O') AS own FROM lineitem GROUP BY 1) s "
    "ON s.trade_date = r.trade_date WHERE daily_files > 0 AND (own IS NULL OR own = 0 OR raw_time > state_time)",
)
def affected_dates_stale(spark, folder):
    """As above, with a state version that is absent from early months and files of even months written too early."""
    raw = tb.table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyyMM").alias("trade_date"),
        F.when(F.col("o_orderstatus") == "O", "daily").otherwise("stock_st").alias("dataset"),
        F.col("o_orderdate").alias("modified_time"),
    )
    shipped = F.col("l_shipdate")
    built = tb.table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "yyyyMM").alias("trade_date"),
        F.col("l_linestatus").alias("state_version"),
        F.when(F.month(shipped) % 2 == 0, shipped - F.expr("INTERVAL 5 DAY")).otherwise(shipped).alias("modified_time"),
    )
    return state.affected_dates(raw, built, "O")


# --- features ---------------------------------------------------------------------------------------

LARGE = [f"amount_{n}d_mean" for n in features.WINDOWS]


def _row(spark, folder):
    return features.row_features(tb.panel(spark, folder))


def _bench(spark, folder):
    returns = features.benchmark_returns(tb.market(spark, folder), tb.BENCHMARK)
    return features.with_benchmark(_row(spark, folder), returns)


def _feature_query(name: str, source: str, build: Callable[[SparkSession, str], DataFrame], columns: Sequence[str], exact: Sequence[str] = ()):
    """Register columns of a feature stage; ``exact`` ones are compared as they are."""
    keys = [*KEYS, *exact]
    query(name, sreport(source, keys, columns, wide=LARGE))(lambda spark, folder: report(build(spark, folder), keys, columns, wide=LARGE))


_feature_query("returns", "base_hist", lambda s, f: features.with_blocks(_row(s, f), features.PRICES), ["ret_1d", "ret_5d", "ret_20d"])
_feature_query("log_size", "base_row", _row, ["amount_log", "vol_log", "log_total_mv", "log_circ_mv"])
_feature_query("flow", "base_row", _row, ["net_mf_amount_to_amount", "large_order_imbalance", "main_mf_strength"])
_feature_query("liquidity", "base_row", _row, ["turnover_cost_proxy", "illiquidity_proxy"])
_feature_query(
    "candle", "base_row", _row,
    ["amplitude", "close_position", "upper_shadow_ratio", "lower_shadow_ratio", "gap_open", "intraday_return"],
)
_feature_query("date_parts", "base_row", _row, [], exact=["weekday", "month", "is_month_end"])
query("illiquidity", sreport("base_row", KEYS, ["illiquidity_proxy"], digits=14))(
    lambda spark, folder: report(_row(spark, folder), KEYS, ["illiquidity_proxy"], digits=14)
)

# every fourth entity's rows moved to the last day of their month, every seventh's by nine days
_MOVED = "CASE WHEN CAST(substr(ts_code, 2) AS INT) % 4 = 0 THEN {last} WHEN CAST(substr(ts_code, 2) AS INT) % 7 = 0 THEN substr(trade_date, 1, 6) || '10' ELSE trade_date END"
_LAST_SQL = _MOVED.format(last="strftime(last_day(strptime(trade_date, '%Y%m%d')), '%Y%m%d')")
oracle.copy_over(["base_row"], "_moved", "base_panel", f"SELECT * REPLACE ({_LAST_SQL} AS trade_date) FROM base_panel")


def _moved(spark: SparkSession, folder: str) -> DataFrame:
    last = "date_format(last_day(to_date(trade_date, 'yyyyMMdd')), 'yyyyMMdd')"
    return features.row_features(tb.panel(spark, folder).withColumn("trade_date", F.expr(_MOVED.format(last=last))))


_feature_query("date_parts_moved", "base_row_moved", _moved, [], exact=["weekday", "month", "is_month_end"])
_feature_query("excess", "base_bench", _bench, ["benchmark_ret_1d", "excess_ret_1d"])
_feature_query(
    "rank_pct", "base_cross",
    lambda s, f: features.cross_rank_pct(tb.panel(s, f), features.DATE_RANKS), ["amount_rank_pct"],
)
_feature_query(
    "winsor", "base_bench", lambda s, f: features.with_winsor(tb.panel(s, f), features.WINSOR_COLUMNS),
    ["pe_ttm_winsor", "pb_winsor", "ps_ttm_winsor"],
)
_feature_query(
    "industry_rank", "base_cross",
    lambda s, f: features.cross_rank_pct(features.with_winsor(_row(s, f), ["pb"]), features.INDUSTRY_RANKS),
    list(features.INDUSTRY_RANKS),
)
_feature_query(
    "industry_neutral", "base_hist",
    lambda s, f: features.with_blocks(features.with_industry_means(_row(s, f)), features.INDUSTRY),
    [
        "industry_ret_1d_mean", "industry_neutral_ret_1d", "industry_neutral_ret_20d", "industry_net_mf_strength_mean",
        "industry_net_mf_positive_ratio",
    ],
)
_feature_query(
    "rsi", "base_hist", lambda s, f: features.with_blocks(_row(s, f), features.RSI), ["rsi_14d"],
)
_feature_query(
    "macd", "base_macd", lambda s, f: features.with_macd(tb.panel(s, f).select(*KEYS, "close")), ["macd_diff", "macd_dea"],
)
_feature_query(
    "moving_average", "base_hist", lambda s, f: features.with_blocks(tb.panel(s, f), features.PRICES),
    ["ma_ratio_5_20", "ma_ratio_20_60", "price_to_ma20", "bollinger_z_20d"],
)
_feature_query(
    "drawdown_high", "base_hist", lambda s, f: features.with_blocks(tb.panel(s, f), features.PRICES), ["max_drawdown_20d"],
    exact=["new_high_20d"],
)
_feature_query(
    "turnover_acceleration", "base_hist",
    lambda s, f: features.with_blocks(tb.panel(s, f), features.TURNOVER),
    ["turnover_acceleration"],
)


for _family in features.ROLLING_FAMILIES:
    _feature_query(
        "rolling_" + _family.replace("_{n}d", ""),
        "base_hist",
        lambda s, f, family=_family: features.with_blocks(_bench(s, f), features.rolling_block(families=[family])),
        [_family.format(n=n) for n in features.WINDOWS],
    )

_feature_query(
    "beta", "base_hist", lambda s, f: features.with_blocks(_bench(s, f), features.beta_block()),
    ["beta_20d", "beta_60d", "residual_ret_20d", "residual_ret_60d"],
)
_feature_query(
    "limit_distance", "trad_row", lambda s, f: features.row_features(tb.tradable_panel(s, f)),
    ["dist_to_limit_up", "dist_to_limit_down", "limit_position"],
    exact=["near_limit_up_2pct", "near_limit_down_2pct", "limit_touch_up", "limit_touch_down"],
)

_ALL = features.published_features()
_MACD = ["macd_diff", "macd_dea"]


def _lag_sql(c: str) -> str:
    return f"lag(CAST({c} AS DOUBLE), 1) OVER ({E}) AS lag1_{c}"


_MART_SOURCE = (
    "(SELECT h.*, m.macd_diff, m.macd_dea, 2 * (m.macd_diff - m.macd_dea) AS macd_hist FROM trad_hist h JOIN trad_macd m "
    "ON m.ts_code = h.ts_code AND m.trade_date = h.trade_date)"
)
_LABELLED = (
    "(SELECT x.*, future_return - benchmark_future_return AS label_rel_return FROM (SELECT h.*, "
    + growth(f"lead(close, 5) OVER (PARTITION BY h.ts_code ORDER BY h.trade_date)", "close")
    + " AS future_return, f.benchmark_future_return FROM {source} h LEFT JOIN bench_fwd f ON f.trade_date = h.trade_date) x)"
)
_LAGGED = "(SELECT trade_date, ts_code, {labels}{lags} FROM {source})"
_LABELS = ", ".join(labels.LABEL_COLUMNS)


def _lagged_sql(names: Sequence[str], source: str) -> str:
    return _LAGGED.format(labels=f"{_LABELS}, ", lags=", ".join(_lag_sql(c) for c in names), source=_LABELLED.format(source=source))


_MART_COLUMNS = [f"lag1_{c}" for c in _ALL]


@query("mart_features", sreport(_lagged_sql(_ALL, _MART_SOURCE), KEYS, _MART_COLUMNS, digits=5, wide=[f"lag1_{c}" for c in LARGE]))
def mart_features(spark, folder):
    """The whole published library on the tradable panel."""
    built, lagged = mart.build_mart(tb.tradable_panel(spark, folder), tb.market(spark, folder), tb.BENCHMARK)
    return report(built, KEYS, lagged, digits=5, wide=[f"lag1_{c}" for c in LARGE])


@query("labels", sreport(_LABELLED.format(source="base_panel"), KEYS, labels.LABEL_COLUMNS))
def label_query(spark, folder):
    forward = labels.benchmark_forward(tb.market(spark, folder), tb.BENCHMARK)
    return report(labels.add_labels(tb.panel(spark, folder), forward), KEYS, labels.LABEL_COLUMNS)


@query("lookahead", "SELECT trade_date, ts_code, " + ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in _MART_COLUMNS) + " FROM wide WHERE false")
def lookahead(spark, folder):
    """Rows of any published feature that would reveal look-ahead when the panel is cut at the end of 1998: none."""

    def build(panel: DataFrame) -> DataFrame:
        made, lagged = mart.build_mart(panel, tb.market(spark, folder), tb.BENCHMARK)
        return report(made, KEYS, lagged, digits=5, wide=[f"lag1_{c}" for c in LARGE])

    return labels.lookahead_rows(build, tb.tradable_panel(spark, folder), "19981201")


@query(
    "lookahead_leak",
    f"SELECT trade_date, ts_code, {sgrid('before')} AS lag1_turnover_rate, CASE WHEN side = 0 THEN {sgrid('next_close')} END AS next_close FROM (SELECT *, "
    f"lead(trade_date) OVER ({E}) AS next_date, lead(close) OVER ({E}) AS next_close, {lag('turnover_rate', 1)} AS before FROM wide), (VALUES (0), (1)) s(side) "
    "WHERE trade_date <= '19981201' AND next_date > '19981201'",
)
def lookahead_leak(spark, folder):
    """The same check of a feature that leaks on purpose: the rows whose next one lies behind the cut, as they were and as they are."""

    def build(panel: DataFrame) -> DataFrame:
        made = panel.select(*KEYS, tb.lagged("turnover_rate", 1).alias("lag1_turnover_rate"), F.expr("lead(close, 1) OVER (PARTITION BY ts_code ORDER BY trade_date)").alias("next_close"))
        return report(made, KEYS, ["lag1_turnover_rate", "next_close"])

    return labels.lookahead_rows(build, tb.wide(spark, folder), "19981201")


@query(
    "mart_summary",
    f"SELECT count(*) AS features_rows, count(label_rel_return) AS dataset_rows, {len(FEATURES)} AS feature_columns, 5 AS label_horizon "
    f"FROM {_LABELLED.format(source='(SELECT p.* FROM tradable_panel p WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.ts_code = p.ts_code AND p.trade_date BETWEEN i.effective_from AND i.effective_to))')}",
)
def mart_summary(spark, folder):
    """Pool members that were tradable."""
    names = [f.removeprefix("lag1_") for f in FEATURES]
    panel = tb.tradable_panel(spark, folder, tb.intervals(spark, folder))
    built, lagged = mart.build_mart(panel, tb.market(spark, folder), tb.BENCHMARK, features=names)
    return mart.mart_summary(built, lagged, 5)


# --- datasets ---------------------------------------------------------------------------------------

SPLIT = {"train": ("19950101", "19981231"), "validation": ("19990101", "19991231"), "test": ("20000101", "20991231")}
_DS = _lagged_sql([f.removeprefix("lag1_") for f in FEATURES], "trad_hist")
oracle.CTES["ds"] = f"SELECT * FROM {_DS} WHERE label_rel_return IS NOT NULL"
_SPLIT_SQL = (
    "CASE WHEN trade_date BETWEEN '19950101' AND '19981231' THEN 'train' WHEN trade_date BETWEEN '19990101' AND '19991231' THEN "
    "'validation' ELSE 'test' END"
)
oracle.CTES["flat"] = f"SELECT *, {_SPLIT_SQL} AS split FROM ds"
FLAT_FEATURES = ["lag1_ret_1d", "lag1_turnover_rate", "lag1_amount_rank_pct", "lag1_ret_5d_mean"]


@query("flat_dataset", sreport("flat", [*KEYS, "split"], [LABEL, *FLAT_FEATURES]))
def flat_dataset(spark, folder):
    flat = datasets.flat_dataset(tb.dataset(spark, folder), [*FLAT_FEATURES, "lag1_not_there"], LABEL, SPLIT)
    return report(flat, [*KEYS, "split"], [LABEL, *FLAT_FEATURES])


SEQ_FEATURES = ["lag1_ret_1d", "lag1_turnover_rate_f", "lag1_ret_5d_mean"]


def _sequence_sql(lookback: int) -> str:
    frame = f"OVER ({E} ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW)"
    whole = " AND ".join(f"count({f}) {frame} = {lookback}" for f in SEQ_FEATURES)
    sums = ", ".join(f"sum(CAST(CAST({f} AS REAL) AS DOUBLE)) {frame} AS s{i}" for i, f in enumerate(SEQ_FEATURES))
    firsts = f"first_value({SEQ_FEATURES[0]}) {frame} AS oldest"
    return (
        f"(SELECT *, {sums}, {firsts}, {whole} AS complete FROM flat) WHERE complete"
    )


@query(
    "sequence_dataset",
    f"SELECT trade_date, ts_code, split, 10 AS steps, {sgrid('CAST(CAST(label_rel_return AS REAL) AS DOUBLE)', 4)} AS y, "
    f"{sgrid('CAST(CAST(oldest AS REAL) AS DOUBLE)', 4)} AS oldest, "
    f"{', '.join(f'{sgrid(f's{i}', 3)} AS s{i}' for i in range(3))} FROM {_sequence_sql(10)}",
)
def sequence_dataset(spark, folder):
    """Sequence windows of ten rows; the nested floats are shown by their sums and their oldest value."""
    seq = datasets.sequence_dataset(tb.dataset(spark, folder), SEQ_FEATURES, 10, LABEL, SPLIT)
    total = lambda i: F.aggregate("x", F.lit(0.0), lambda acc, step: acc + step[i].cast("double"))
    return seq.select(
        *KEYS, "split", F.size("x").alias("steps"), grid(F.col("y").cast("double"), 4).alias("y"),
        grid(F.col("x")[0][0].cast("double"), 4).alias("oldest"), *[grid(total(i), 3).alias(f"s{i}") for i in range(3)],
    )


@query(
    "dataset_manifest",
    f"SELECT 'v1' AS data_version, 'flat' AS dataset, {len(FLAT_FEATURES)} AS features, split, count(*) AS rows FROM flat GROUP BY split UNION ALL "
    f"SELECT 'v1', 'sequence_10', {len(SEQ_FEATURES)}, split, count(*) FROM {_sequence_sql(10)} GROUP BY split UNION ALL "
    f"SELECT 'v1', 'sequence_20', {len(SEQ_FEATURES)}, split, count(*) FROM {_sequence_sql(20)} GROUP BY split",
)
def dataset_manifest(spark, folder):
    df = tb.dataset(spark, folder)
    tables = {"flat": (datasets.flat_dataset(df, FLAT_FEATURES, LABEL, SPLIT), len(FLAT_FEATURES))}
    for n in (10, 20):
        tables[f"sequence_{n}"] = (datasets.sequence_dataset(df, SEQ_FEATURES, n, LABEL, SPLIT), len(SEQ_FEATURES))
    return datasets.manifest(tables, tb.STATE_VERSION)


# --- factor reports ---------------------------------------------------------------------------------

oracle.CTES["long"] = " UNION ALL ".join(
    f"SELECT trade_date, ts_code, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, label_rel_return AS y FROM ds" for f in FEATURES
)


def _pearson(x: str, y: str) -> str:
    return div(f"covar_pop({x}, {y})", f"stddev_pop({x}) * stddev_pop({y})")


def _ic_ctes(name: str, source: str) -> None:
    oracle.CTES[f"{name}_ranked"] = (
        f"SELECT *, {avg_rank('x', 'trade_date, feature')} AS rx, {avg_rank('y', 'trade_date, feature')} AS ry "
        f"FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL"
    )
    oracle.CTES[name] = (
        f"SELECT trade_date, feature, {_pearson('x', 'y')} AS ic, {_pearson('rx', 'ry')} AS rank_ic, count(*) AS n "
        f"FROM {name}_ranked GROUP BY 1, 2 HAVING count(*) >= {MIN_CS}"
    )


_IC_STATS = (
    "avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, " + div("avg(ic)", "stddev_samp(ic)") + " * sqrt(count(ic)) AS ic_t_stat, "
    "avg(rank_ic) AS rank_ic_mean, stddev_samp(rank_ic) AS rank_ic_std, "
    + div("avg(rank_ic)", "stddev_samp(rank_ic)") + " * sqrt(count(rank_ic)) AS rank_ic_t_stat, "
    "avg(CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END) AS positive_rank_ic_ratio, "
    "count(rank_ic) AS days, avg(n) AS avg_cross_section"
)
IC_VALUES = [
    "ic_mean", "ic_std", "ic_t_stat", "rank_ic_mean", "rank_ic_std", "rank_ic_t_stat", "positive_rank_ic_ratio", "avg_cross_section",
]
_ic_ctes("dic", "long")
oracle.CTES["feature_list"] = f"SELECT unnest({FEATURES}) AS feature"
oracle.CTES["ics"] = (
    f"SELECT l.feature, s.* EXCLUDE (feature, days), coalesce(s.days, 0) AS days FROM feature_list l "
    f"LEFT JOIN (SELECT feature, {_IC_STATS} FROM dic GROUP BY 1) s ON s.feature = l.feature"
)


@query("daily_ic", sreport("dic", ["trade_date", "feature", "n"], ["ic", "rank_ic"]))
def daily_ic(spark, folder):
    table = factors.daily_ic(tb.dataset(spark, folder), FEATURES, LABEL, MIN_CS)
    return report(table, ["trade_date", "feature", "n"], ["ic", "rank_ic"])


@query("ic_summary", sreport("ics", ["feature", "days"], IC_VALUES))
def ic_summary(spark, folder):
    daily = factors.daily_ic(tb.dataset(spark, folder), FEATURES, LABEL, MIN_CS)
    return report(factors.ic_summary(daily, FEATURES), ["feature", "days"], IC_VALUES)


QUANTILES = 5
SPREAD_VALUES = [
    "q1_mean_return", "q_top_mean_return", "long_short_mean_return", "long_short_t_stat", "long_short_win_ratio",
    "long_short_max_drawdown",
]


def _bucket_cte(name: str, source: str, q: int) -> None:
    oracle.CTES[name] = (
        f"SELECT *, CAST(least(floor((r - 1) * {q} / n) + 1, {q}) AS INTEGER) AS bucket FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY trade_date, feature ORDER BY x, ts_code) AS r, "
        f"CAST(count(*) OVER (PARTITION BY trade_date, feature) AS DOUBLE) AS n, "
        f"min(x) OVER (PARTITION BY trade_date, feature) AS lo, max(x) OVER (PARTITION BY trade_date, feature) AS hi "
        f"FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL) WHERE n >= {max(q, MIN_CS)} AND lo <> hi"
    )


def _spread_sql(buckets: str, q: int, by: str = "") -> str:
    g = f"{by}, feature" if by else "feature"
    frame = f"OVER (PARTITION BY {g} ORDER BY trade_date ROWS UNBOUNDED PRECEDING)"
    return (
        f"SELECT {g}, {q} AS quantiles, avg(bottom) AS q1_mean_return, avg(top) AS q_top_mean_return, avg(ls) AS long_short_mean_return, "
        f"{div('avg(ls)', 'stddev_samp(ls)')} * sqrt(count(ls)) AS long_short_t_stat, "
        f"CASE WHEN count(ls) > 0 THEN avg(CASE WHEN ls > 0 THEN 1.0 ELSE 0.0 END) END AS long_short_win_ratio, "
        f"CASE WHEN count(ls) > 0 THEN min(dd) END AS long_short_max_drawdown, count(ls) AS days FROM ("
        f"SELECT *, {growth('wealth', f'max(wealth) {frame}')} AS dd FROM (SELECT *, product(1 + coalesce(ls, 0)) {frame} AS wealth FROM ("
        f"SELECT *, top - bottom AS ls FROM (SELECT {g}, trade_date, avg(CASE WHEN bucket = 1 THEN y END) AS bottom, "
        f"avg(CASE WHEN bucket = {q} THEN y END) AS top FROM {buckets} GROUP BY {g}, trade_date)))) GROUP BY {g}"
    )


_bucket_cte("b5", "long", QUANTILES)
_bucket_cte("b7", "long", 7)
oracle.CTES["ls5"] = _spread_sql("b5", QUANTILES)
oracle.CTES["regime_src"] = (
    f"SELECT trade_date, {growth('close', lag('close', 20))} AS benchmark_ret_20d, {growth('close', lag('close', 60))} AS benchmark_ret_60d, "
    f"{roll('stddev_samp', growth('close', 'pre_close'), 20, 10)} AS benchmark_vol_20d FROM market"
)
oracle.CTES["amount_rank"] = (
    "SELECT a.trade_date, CASE WHEN count(*) >= 20 THEN (count(*) FILTER (b.amount < a.amount) + (count(*) FILTER (b.amount = a.amount) + 1) / 2.0) "
    "/ count(*) END AS benchmark_amount_rank_60d FROM (SELECT *, row_number() OVER (ORDER BY trade_date) AS k FROM market) a JOIN "
    "(SELECT *, row_number() OVER (ORDER BY trade_date) AS k FROM market) b ON b.k BETWEEN a.k - 59 AND a.k GROUP BY a.trade_date"
)
oracle.CTES["regime"] = (
    "SELECT trade_date, CASE WHEN benchmark_vol_20d >= (SELECT quantile_cont(benchmark_vol_20d, 2/3) FROM regime_src) THEN 'high_vol' "
    "WHEN benchmark_ret_20d >= (SELECT quantile_cont(benchmark_ret_20d, 2/3) FROM regime_src) THEN 'bull' "
    "WHEN benchmark_ret_20d <= (SELECT quantile_cont(benchmark_ret_20d, 1/3) FROM regime_src) THEN 'bear' ELSE 'sideways' END AS market_regime "
    "FROM regime_src"
)


@query("quantile_spread", sreport("ls5", ["feature", "quantiles", "days"], SPREAD_VALUES))
def quantile_spread(spark, folder):
    table = factors.quantile_spread(tb.dataset(spark, folder), FEATURES, LABEL, QUANTILES, MIN_CS)
    return report(table, ["feature", "quantiles", "days"], SPREAD_VALUES)


@query(
    "quantile_buckets",
    "SELECT trade_date, feature, bucket, count(*) AS rows, count(DISTINCT ts_code) AS ts_codes FROM b7 GROUP BY 1, 2, 3",
)
def quantile_buckets(spark, folder):
    """Bucket sizes with a bucket count that does not divide the cross-section."""
    rows = factors.quantile_rows(tb.dataset(spark, folder), FEATURES, LABEL, 7, MIN_CS)
    return rows.groupBy("trade_date", "feature", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ts_code").alias("ts_codes")
    )


def _detail_sql(buckets: str) -> str:
    return (
        f"SELECT feature, quantile, {sgrid('mean_return')} AS mean_return, up OR down AS is_monotonic, CASE WHEN up THEN 'up' WHEN down THEN "
        f"'down' ELSE 'none' END AS monotonic_direction FROM (SELECT *, count(*) OVER w = {QUANTILES} AND coalesce(bool_and(step >= 0) OVER w, true) "
        f"AS up, count(*) OVER w = {QUANTILES} AND coalesce(bool_and(step <= 0) OVER w, true) AS down FROM (SELECT *, mean_return - "
        f"lag(mean_return) OVER (PARTITION BY feature ORDER BY quantile) AS step FROM (SELECT feature, bucket AS quantile, avg(y) AS mean_return "
        f"FROM {buckets} GROUP BY 1, 2)) WINDOW w AS (PARTITION BY feature))"
    )


def _detail(df: DataFrame) -> DataFrame:
    table = factors.quantile_detail(df, FEATURES, LABEL, QUANTILES, MIN_CS)
    return report(table, ["feature", "quantile", "is_monotonic", "monotonic_direction"], ["mean_return"])


query("quantile_detail", _detail_sql("b5"))(lambda spark, folder: _detail(tb.dataset(spark, folder)))


@query(
    "quantile_year",
    sreport(f"({_spread_sql('(SELECT *, substr(trade_date, 1, 4) AS year FROM b5)', QUANTILES, 'year')})", ["year", "feature", "quantiles", "days"], SPREAD_VALUES),
)
def quantile_year(spark, folder):
    table = factors.yearly_quantile_spread(tb.dataset(spark, folder), FEATURES, LABEL, QUANTILES, MIN_CS)
    return report(table, ["year", "feature", "quantiles", "days"], SPREAD_VALUES)


def _regimes(spark, folder):
    return regimes.label_regimes(regimes.regime_source(tb.market(spark, folder), tb.BENCHMARK))


@query(
    "quantile_regime",
    sreport(
        f"({_spread_sql('(SELECT b.*, r.market_regime FROM b5 b JOIN regime r ON r.trade_date = b.trade_date)', QUANTILES, 'market_regime')})",
        ["market_regime", "feature", "quantiles", "days"], SPREAD_VALUES,
    ),
)
def quantile_regime(spark, folder):
    table = regimes.regime_quantile_spread(
        tb.dataset(spark, folder), _regimes(spark, folder), FEATURES, LABEL, QUANTILES, MIN_CS
    )
    return report(table, ["market_regime", "feature", "quantiles", "days"], SPREAD_VALUES)


@query(
    "regime_labels",
    sreport(
        "(SELECT s.*, a.benchmark_amount_rank_60d, r.market_regime FROM regime_src s JOIN amount_rank a ON a.trade_date = s.trade_date "
        "JOIN regime r ON r.trade_date = s.trade_date)",
        ["trade_date", "market_regime"], ["benchmark_ret_20d", "benchmark_ret_60d", "benchmark_vol_20d", "benchmark_amount_rank_60d"],
    ),
)
def regime_labels(spark, folder):
    source = regimes.regime_source(tb.market(spark, folder), tb.BENCHMARK)
    table = source.join(regimes.label_regimes(source), "trade_date")
    return report(
        table, ["trade_date", "market_regime"],
        ["benchmark_ret_20d", "benchmark_ret_60d", "benchmark_vol_20d", "benchmark_amount_rank_60d"],
    )


@query(
    "regime_ic",
    sreport(
        f"(SELECT k.market_regime, k.feature, s.* EXCLUDE (market_regime, feature, days), coalesce(s.days, 0) AS days FROM (SELECT DISTINCT r.market_regime, l.feature "
        f"FROM dic d JOIN regime r ON r.trade_date = d.trade_date, feature_list l) k LEFT JOIN (SELECT r.market_regime, d.feature, {_IC_STATS} "
        f"FROM dic d JOIN regime r ON r.trade_date = d.trade_date GROUP BY 1, 2) s ON s.market_regime = k.market_regime AND s.feature = k.feature)",
        ["market_regime", "feature", "days"], IC_VALUES,
    ),
)
def regime_ic(spark, folder):
    daily = stage_daily_ic(spark, folder)
    table = regimes.regime_ic_summary(daily, _regimes(spark, folder), FEATURES)
    return report(table, ["market_regime", "feature", "days"], IC_VALUES)


def stage_daily_ic(spark, folder):
    """The daily table is a stored report; slices read it."""
    return tb.stored(
        spark, folder, "daily_ic", lambda s, f: factors.daily_ic(tb.dataset(s, f), FEATURES, LABEL, MIN_CS)
    )


_EXPOSED = "lag1_log_circ_mv AS a, lag1_turnover_rate_f AS b"
oracle.CTES["exposed"] = " UNION ALL ".join(
    f"SELECT trade_date, ts_code, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, label_rel_return AS y, {_EXPOSED} FROM ds"
    for f in FEATURES
    if f not in factors.NOT_NEUTRALIZED
)
oracle.CTES["moments"] = (
    "SELECT trade_date, feature, count(*) AS n, min(v) <> max(v) AS varies, avg(a) AS ma, avg(b) AS mb, avg(v) AS mv, var_pop(a) AS vaa, "
    "var_pop(b) AS vbb, covar_pop(a, b) AS vab, covar_pop(a, v) AS vav, covar_pop(b, v) AS vbv FROM exposed "
    "WHERE a IS NOT NULL AND b IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2"
)
oracle.CTES["resid"] = (
    "SELECT e.trade_date, e.ts_code, e.feature || '__neutral' AS feature, e.y, (e.v - m.mv) "
    "- (m.vav * m.vbb - m.vbv * m.vab) / (m.vaa * m.vbb - m.vab * m.vab) * (e.a - m.ma) "
    "- (m.vbv * m.vaa - m.vav * m.vab) / (m.vaa * m.vbb - m.vab * m.vab) * (e.b - m.mb) AS x "
    "FROM exposed e LEFT JOIN moments m ON m.trade_date = e.trade_date AND m.feature = e.feature AND m.n > 4 AND m.varies "
    "AND m.vaa * m.vbb - m.vab * m.vab > 1e-12 * m.vaa * m.vbb"
)
_ic_ctes("nic", "resid")
NEUTRAL = [f"{f}__neutral" for f in FEATURES if f not in factors.NOT_NEUTRALIZED]


@query("neutral_residuals", sreport("resid", [*KEYS, "feature"], ["x"]))
def neutral_residuals(spark, folder):
    return report(factors.neutral_rows(tb.dataset(spark, folder), FEATURES, LABEL), [*KEYS, "feature"], ["x"])


# flags and calendar parts leave residuals that tie up to rounding, so their ranks are not comparable
SMOOTH = [f for f in FEATURES if f not in ("lag1_month", "lag1_limit_touch_up", "lag1_amount_rank_pct")]
_SMOOTH_NEUTRAL = [f"{f}__neutral" for f in SMOOTH if f not in factors.NOT_NEUTRALIZED]


@query(
    "neutral_ic",
    sreport(
        f"(SELECT l.feature, s.* EXCLUDE (feature, days), coalesce(s.days, 0) AS days FROM (SELECT unnest({_SMOOTH_NEUTRAL}) AS feature) l "
        f"LEFT JOIN (SELECT feature, {_IC_STATS} FROM nic GROUP BY 1) s ON s.feature = l.feature)",
        ["feature", "days"], IC_VALUES,
    ),
)
def neutral_ic(spark, folder):
    table = factors.neutral_ic_summary(tb.dataset(spark, folder), SMOOTH, LABEL, MIN_CS)
    return report(table, ["feature", "days"], IC_VALUES)


QUALITY_VALUES = ["missing_ratio", "finite_ratio", "zero_ratio", "mean", "std", "min", "p01", "p50", "p99", "max"]
oracle.CTES["qual"] = (
    "SELECT feature, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS missing_ratio, avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END) AS "
    "finite_ratio, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS zero_ratio, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, "
    "quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.99) AS p99, max(x) AS max, "
    "count(DISTINCT x) AS unique_values FROM long GROUP BY 1"
)


@query("quality", sreport("qual", ["feature", "unique_values"], QUALITY_VALUES))
def quality(spark, folder):
    return report(factors.quality(tb.dataset(spark, folder), FEATURES), ["feature", "unique_values"], QUALITY_VALUES)


def _pair_sql(feature_list: Sequence[str]) -> str:
    parts = []
    for i, a in enumerate(feature_list):
        for b in feature_list[i + 1 :]:
            both = f"(SELECT CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM ds WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            ranked = (
                f"(SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, "
                f"rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM {both})"
            )
            parts.append(f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, {_pearson('ra', 'rb')} AS spearman_corr, count(*) AS n FROM {ranked}")
    return " UNION ALL ".join(parts)


oracle.CTES["corr"] = (
    f"SELECT feature_left, feature_right, spearman_corr FROM ({_pair_sql(FEATURES)}) "
    f"WHERE spearman_corr IS NOT NULL AND n >= greatest(20, (SELECT count(*) FROM ds) // 100)"
)


@query("correlation", sreport("corr", ["feature_left", "feature_right"], ["spearman_corr"]))
def correlation(spark, folder):
    table = factors.correlation_pairs(tb.dataset(spark, folder), FEATURES, top_n=None)
    return report(table, ["feature_left", "feature_right"], ["spearman_corr"])


@query(
    "correlation_top",
    sreport("(SELECT * FROM corr ORDER BY abs(spearman_corr) DESC LIMIT 20)", ["feature_left", "feature_right"], ["spearman_corr"]),
)
def correlation_top(spark, folder):
    table = factors.correlation_pairs(tb.dataset(spark, folder), FEATURES, top_n=20)
    return report(table, ["feature_left", "feature_right"], ["spearman_corr"])


# --- selection --------------------------------------------------------------------------------------

TRAIN_END, EVAL_START, MAX_CORR = "19981231", "19990101", 0.6

oracle.CTES["scored"] = (
    "SELECT i.feature, coalesce(abs(i.rank_ic_mean), 0) * 100 + coalesce(abs(l.long_short_mean_return), 0) * 100 "
    "+ coalesce(l.long_short_win_ratio, 0) * 0.5 - coalesce(q.missing_ratio, 1) * 0.5 AS score, q.unique_values, q.missing_ratio, "
    "i.rank_ic_mean, l.long_short_mean_return, l.long_short_t_stat "
    "FROM ics i LEFT JOIN ls5 l ON l.feature = i.feature LEFT JOIN qual q ON q.feature = i.feature"
)


@query("feature_score", sreport("scored", ["feature", "unique_values"], ["score"]))
def feature_score(spark, folder):
    df = tb.dataset(spark, folder)
    scored = selection.scored_features(
        FEATURES,
        factors.ic_summary(stage_daily_ic(spark, folder), FEATURES),
        factors.quantile_spread(df, FEATURES, LABEL, QUANTILES, MIN_CS),
        factors.quality(df, FEATURES),
    )
    return report(scored, ["feature", "unique_values"], ["score"])


_REPORT_BLOCKS = ["long", "dic_ranked", "dic", "ics", "b5", "ls5", "qual", "corr", "scored"]
oracle.copy_over(_REPORT_BLOCKS, "_train", "ds", f"SELECT * FROM ds WHERE trade_date <= '{TRAIN_END}'")
oracle.copy_over(["long", "b5", "ls5"], "_eval", "ds", f"SELECT * FROM ds WHERE trade_date >= '{EVAL_START}'")

# two features that follow the label, up and down
oracle.copy_over(
    ["long", "b5"], "_followed", "ds", f"SELECT * REPLACE ({LABEL} AS lag1_ret_1d, -{LABEL} AS lag1_turnover_rate) FROM ds"
)
query("quantile_detail_followed", _detail_sql("b5_followed"))(
    lambda spark, folder: _detail(tb.dataset(spark, folder).withColumns({"lag1_ret_1d": F.col(LABEL), "lag1_turnover_rate": -F.col(LABEL)}))
)

_GROUP = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in g)}) THEN {i}" for i, g in enumerate(selection.NEAR_DUPLICATES)) + " END"
_RESERVED = " OR ".join(f"contains(feature, '{part}')" for part in selection.SEQUENCE_ONLY)
oracle.CTES["gated"] = (
    f"SELECT *, CASE WHEN missing_ratio IS NULL OR missing_ratio > 0.35 OR unique_values < 5 THEN 'low' WHEN {_RESERVED} THEN 'reserved' "
    f"WHEN grp IS NOT NULL AND winner <> feature THEN 'duplicate' WHEN rank_ic_mean IS NULL AND long_short_mean_return IS NULL THEN 'no_signal' "
    f"WHEN abs(rank_ic_mean) >= 0.015 OR abs(long_short_mean_return) >= 0.006 OR abs(long_short_t_stat) >= 2 THEN 'candidate' ELSE 'weak' END AS gate "
    f"FROM (SELECT *, first_value(feature) OVER (PARTITION BY grp ORDER BY score DESC, feature) AS winner FROM (SELECT *, {_GROUP} AS grp FROM scored_train))"
)
oracle.CTES["strong_pairs"] = (
    f"SELECT feature_left AS a, feature_right AS b FROM corr_train WHERE abs(spearman_corr) >= {MAX_CORR} UNION ALL "
    f"SELECT feature_right, feature_left FROM corr_train WHERE abs(spearman_corr) >= {MAX_CORR}"
)
oracle.CTES["candidates"] = (
    "SELECT row_number() OVER (ORDER BY score DESC, feature) AS k, feature, coalesce(near, []) AS near FROM gated "
    "LEFT JOIN (SELECT a, list(b) AS near FROM strong_pairs GROUP BY 1) n ON n.a = feature WHERE gate = 'candidate'"
)
oracle.CTES["walk"] = (
    "SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS feature, CAST([] AS VARCHAR[]) AS picked, CAST(NULL AS VARCHAR) AS blocker UNION ALL "
    "SELECT k, feature, CASE WHEN blocker IS NULL THEN list_append(picked, feature) ELSE picked END, blocker FROM (SELECT c.k, c.feature, w.picked, "
    "list_filter(w.picked, lambda p: list_contains(c.near, p))[1] AS blocker FROM walk w JOIN candidates c ON c.k = w.k + 1)"
)
oracle.CTES["classes"] = (
    "SELECT g.feature, g.unique_values, g.score, g.missing_ratio, g.rank_ic_mean, g.long_short_mean_return, "
    "CASE WHEN gate IN ('low', 'no_signal') THEN 'drop' WHEN gate = 'candidate' AND w.blocker IS NULL THEN 'baseline' ELSE 'advanced' END AS recommendation, "
    "CASE gate WHEN 'low' THEN 'low_coverage_or_low_variation' WHEN 'reserved' THEN 'reserved_for_advanced_or_sequence_model' "
    "WHEN 'duplicate' THEN 'pruned_by_collinearity_group:' || winner WHEN 'no_signal' THEN 'no_validation_signal' "
    "WHEN 'weak' THEN 'weak_but_potential_sequence_signal' ELSE coalesce('correlated_with_baseline:' || w.blocker, 'stable_cross_section_signal') END AS reason "
    "FROM gated g LEFT JOIN walk w ON w.feature = g.feature"
)
_CLASS_KEYS = ["feature", "recommendation", "reason", "unique_values"]
_CLASS_VALUES = ["score", "missing_ratio", "rank_ic_mean", "long_short_mean_return"]


@query("recommend", sreport("classes", _CLASS_KEYS, _CLASS_VALUES))
def recommend(spark, folder):
    """Scores and classes from the training window."""
    df = tb.dataset(spark, folder).where(F.col("trade_date") <= TRAIN_END)
    return report(reports.recommendation(df, FEATURES, LABEL, QUANTILES, MIN_CS, MAX_CORR), _CLASS_KEYS, _CLASS_VALUES)


def _placed_sql(section: str, value: str, limit: bool) -> str:
    size = f"abs({value})" if limit else value
    inner = f"SELECT {section} AS section, feature, {value} AS value, row_number() OVER (PARTITION BY {section} ORDER BY {size} DESC NULLS LAST, feature) AS place FROM classes"
    return f"SELECT * FROM ({inner})" + (" WHERE value IS NOT NULL AND place <= 10" if limit else "")


_SUMMARY = " UNION ALL ".join([
    _placed_sql("recommendation", "score", False),
    _placed_sql("'top_rank_ic'", "rank_ic_mean", True),
    _placed_sql("'top_spread'", "long_short_mean_return", True),
])


@query("class_summary", sreport(f"({_SUMMARY})", ["section", "feature", "place"], ["value"]))
def class_summary(spark, folder):
    """Features of each class, and the strongest by rank IC and spread."""
    df = tb.dataset(spark, folder).where(F.col("trade_date") <= TRAIN_END)
    classes = reports.recommendation(df, FEATURES, LABEL, QUANTILES, MIN_CS, MAX_CORR)
    return report(reports.class_summary(classes).withColumn("place", F.col("place").cast("long")), ["section", "feature", "place"], ["value"])


@query(
    "holdout_spread",
    sreport(
        "(SELECT l.* FROM ls5_eval l JOIN classes c ON c.feature = l.feature WHERE c.recommendation <> 'drop')",
        ["feature", "quantiles", "days"], SPREAD_VALUES,
    ),
)
def holdout_spread(spark, folder):
    """Features chosen on the training window, judged on the later one."""
    table = reports.holdout(tb.dataset(spark, folder), FEATURES, LABEL, TRAIN_END, EVAL_START, QUANTILES, MIN_CS, MAX_CORR)
    return report(table, ["feature", "quantiles", "days"], SPREAD_VALUES)


@query(
    "report_summary",
    "SELECT count(*) AS rows, count(DISTINCT trade_date) AS trade_dates, count(DISTINCT ts_code) AS ts_codes FROM ds",
)
def report_summary(spark, folder):
    return state.query_summary(tb.dataset(spark, folder))


def _many_buckets(name: str) -> QueryFn:
    """The same query with its groups cut into many buckets, as large groups are."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        before = {key: spark.conf.get(key, None) for key in (ROWS_PER_BUCKET_KEY, MAX_CUTS_KEY)}
        spark.conf.set(ROWS_PER_BUCKET_KEY, "16")
        spark.conf.set(MAX_CUTS_KEY, "8")
        try:
            return QUERIES[name](spark, folder)
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    return run


for _name in ("rank_pct", "winsor", "industry_rank", "daily_ic", "quantile_buckets", "quality"):
    QUERIES[f"{_name}_cut"] = _many_buckets(_name)
    ORACLE[f"{_name}_cut"] = ORACLE[_name]
