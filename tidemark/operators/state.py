"""Daily trading state: validity flags, price limits by board and reform date, tradability."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.scalars import ColumnOrName, col, date_text, round_to_tick
from tidemark.operators.calendar import with_listed_days
from tidemark.operators.coverage import missing_dates
from tidemark.operators.membership import intervals_touching, members_only
from tidemark.operators.panel import latest

STATE_COLUMNS = [
    "trade_date", "ts_code", "is_st", "is_suspended", "is_limit_up", "is_limit_down", "is_tradable", "listed_days",
    "listed_trading_days", "market_board", "has_price_limit", "limit_ratio", "limit_up_price", "limit_down_price",
    "limit_rule_id", "limit_rule_reason", "volume_valid", "price_valid", "state_version", "created_at",
]

PRICES = ["open", "high", "low", "close", "pre_close"]

# The default rule set of the market.
DEFAULT_LIMIT_RULES: dict[str, Any] = {
    "tick_size": 0.01,
    "price_tolerance": 0.000001,
    "boards": {
        "chinext": {
            "code_patterns": [r"^30\d{4}\.SZ$"],
            "reforms": [
                {"effective_from": "19000101", "normal_limit_ratio": 0.10, "st_limit_ratio": 0.05, "ipo_no_limit_trading_days": 0},
                {"effective_from": "20200824", "normal_limit_ratio": 0.20, "st_limit_ratio": 0.20, "ipo_no_limit_trading_days": 5},
            ],
        },
        "sz_main": {
            "code_patterns": [r"^00\d{4}\.SZ$"],
            "reforms": [
                {"effective_from": "19000101", "normal_limit_ratio": 0.10, "st_limit_ratio": 0.05, "ipo_no_limit_trading_days": 0},
                {"effective_from": "20230410", "normal_limit_ratio": 0.10, "st_limit_ratio": 0.05, "ipo_no_limit_trading_days": 5},
            ],
        },
        "sh_main": {
            "code_patterns": [r"^60\d{4}\.SH$"],
            "reforms": [
                {"effective_from": "19000101", "normal_limit_ratio": 0.10, "st_limit_ratio": 0.05, "ipo_no_limit_trading_days": 0},
                {"effective_from": "20230410", "normal_limit_ratio": 0.10, "st_limit_ratio": 0.05, "ipo_no_limit_trading_days": 5},
            ],
        },
        "star": {
            "code_patterns": [r"^68\d{4}\.SH$"],
            "reforms": [
                {"effective_from": "19000101", "normal_limit_ratio": 0.20, "st_limit_ratio": 0.20, "ipo_no_limit_trading_days": 5},
            ],
        },
        "unknown": {
            "code_patterns": [],
            "reforms": [
                {"effective_from": "19000101", "normal_limit_ratio": 0.10, "st_limit_ratio": 0.05, "ipo_no_limit_trading_days": 0},
            ],
        },
    },
}
# The market text of the growth board, and the ratio where no rule applies.
CHINEXT_MARKET_PATTERN = "(?i)创业|CYB|ChiNext"
DEFAULT_RATIO = 0.10
_BEGINNING, _END = "00000000", "99999999"


def market_board(code: ColumnOrName, market: ColumnOrName, rules: dict[str, Any]) -> Column:
    """The board of an entity: a later board's code pattern wins over an earlier one and over the
    market text; 'unknown' otherwise."""
    choice = F.when(F.coalesce(col(market), F.lit("")).rlike(CHINEXT_MARKET_PATTERN), "chinext").otherwise("unknown")
    for board, rule in rules["boards"].items():
        for pattern in rule.get("code_patterns", []):
            choice = F.when(col(code).rlike(f"^(?:{pattern})"), board).otherwise(choice)
    return choice


def rule_table(spark: SparkSession, rules: dict[str, Any]) -> DataFrame:
    """One row per (board, reform) with its validity range; a board's first reform also covers the time
    before it. The size is that of the configuration."""
    rows = []
    for board, rule in rules["boards"].items():
        reforms = sorted(rule.get("reforms", []), key=lambda r: str(r["effective_from"])) or [{}]
        for i, reform in enumerate(reforms):
            normal = float(reform.get("normal_limit_ratio", DEFAULT_RATIO))
            rows.append(
                (
                    board,
                    str(reform.get("effective_from")),
                    _BEGINNING if i == 0 else str(reform["effective_from"]),
                    str(reforms[i + 1]["effective_from"]) if i + 1 < len(reforms) else _END,
                    normal,
                    float(reform.get("st_limit_ratio", normal)),
                    int(reform.get("ipo_no_limit_trading_days", 0)),
                )
            )
    schema = (
        "market_board string, reform_from string, valid_from string, valid_before string, "
        "normal_ratio double, st_ratio double, ipo_days int"
    )
    return spark.createDataFrame(rows, schema)


def with_active_rule(df: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Attach the reform in force on each row's board and date."""
    table = F.broadcast(rule_table(df.sparkSession, rules)).withColumnRenamed("market_board", "_board")
    in_force = (
        (F.col("market_board") == F.col("_board"))
        & (F.col("trade_date") >= F.col("valid_from"))
        & (F.col("trade_date") < F.col("valid_before"))
    )
    return df.join(table, in_force, "left").drop("_board", "valid_from", "valid_before")


def with_price_limits(df: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Price-limit columns from ts_code, market, trade_date, is_st, listed_days, pre_close and close."""
    tick, tolerance = float(rules.get("tick_size", 0.01)), float(rules.get("price_tolerance", 0.000001))
    ruled = with_active_rule(
        df.withColumn("listed_trading_days", F.col("listed_days").cast("long")).withColumn(
            "market_board", market_board("ts_code", "market", rules)
        ),
        rules,
    )
    known = F.col("reform_from").isNotNull()
    free = known & (F.col("listed_trading_days") <= F.col("ipo_days"))
    board, reform = F.col("market_board"), F.col("reform_from")
    days = F.col("ipo_days").cast("string")
    out = ruled.withColumns(
        {
            "has_price_limit": ~free,
            "limit_ratio": F.when(free, F.lit(None).cast("double"))
            .when(~known, F.lit(DEFAULT_RATIO))
            .when(F.col("is_st"), F.col("st_ratio"))
            .otherwise(F.col("normal_ratio")),
            "limit_rule_id": F.when(free, F.concat_ws("_", board, "trade_date", F.lit("ipo_no_limit")))
            .when(~known, F.lit("unknown_default_normal"))
            .otherwise(F.concat_ws("_", board, reform, F.when(F.col("is_st"), "st").otherwise("normal"))),
            "limit_rule_reason": F.when(free, F.concat(F.lit("first_"), days, F.lit("_trading_days_no_limit")))
            .when(~known, F.lit("fallback_default_limit"))
            .when(F.col("is_st"), F.lit("risk_warning_limit"))
            .otherwise(F.lit("normal_limit")),
        }
    )
    limited = F.col("has_price_limit") & (F.col("pre_close") > 0)
    out = out.withColumns(
        {
            "limit_up_price": F.when(limited, round_to_tick(F.col("pre_close") * (1 + F.col("limit_ratio")), tick)),
            "limit_down_price": F.when(limited, round_to_tick(F.col("pre_close") * (1 - F.col("limit_ratio")), tick)),
        }
    )
    return out.withColumns(
        {
            "is_limit_up": F.coalesce(F.col("close") >= F.col("limit_up_price") - tolerance, F.lit(False)),
            "is_limit_down": F.coalesce(F.col("close") <= F.col("limit_down_price") + tolerance, F.lit(False)),
        }
    ).drop("reform_from", "normal_ratio", "st_ratio", "ipo_days")


def daily_state(
    daily: DataFrame,
    basic: DataFrame,
    st: DataFrame,
    days: DataFrame | None,
    rules: dict[str, Any],
    version: str,
    min_listed_days: int = 0,
    recency: list[str] | None = None,
) -> DataFrame:
    """The state of every (date, entity) row of ``daily``, all dates in one plan.

    Copies of a key are reduced to the most recent one by ``recency``; without it rows must be unique.
    """
    numeric = [*PRICES, "vol"]
    recency = recency or []
    prices = daily.select(
        date_text("trade_date").alias("trade_date"),
        F.col("ts_code").cast("string").alias("ts_code"),
        *[(F.col(c) if c in daily.columns else F.lit(None)).try_cast("double").alias(c) for c in numeric],
        *recency,
    )
    if recency:
        prices = latest(prices, ["trade_date", "ts_code"], recency)
    market = F.col("market") if "market" in basic.columns else F.lit(None)
    dim = basic.select("ts_code", date_text("list_date").alias("list_date"), market.cast("string").alias("market"))
    dim = latest(dim, ["ts_code"], ["list_date", "market"])
    flagged = st.select(date_text("trade_date").alias("trade_date"), "ts_code").distinct().withColumn("_st", F.lit(True))
    rows = prices.join(flagged, ["trade_date", "ts_code"], "left").join(dim, "ts_code", "left")
    all_prices = F.lit(True)
    for c in PRICES:
        all_prices = all_prices & F.col(c).isNotNull()
    rows = rows.withColumns(
        {
            "is_st": F.coalesce("_st", F.lit(False)),
            "price_valid": F.coalesce(all_prices & (F.col("close") > 0), F.lit(False)),
            "volume_valid": F.coalesce(F.col("vol") > 0, F.lit(False)),
        }
    ).withColumn("is_suspended", ~F.col("volume_valid"))
    rows = with_price_limits(with_listed_days(rows, days), rules)
    tradable = (
        ~F.col("is_st") & F.col("price_valid") & F.col("volume_valid") & (F.col("listed_days") >= F.lit(min_listed_days))
    )
    return rows.withColumns(
        {"is_tradable": tradable, "state_version": F.lit(version), "created_at": F.current_timestamp()}
    ).select(*STATE_COLUMNS)


def state_checks(state: DataFrame) -> DataFrame:
    """Each consistency rule with the number of rows that break it, from one pass."""
    both_limits = F.col("limit_up_price").isNotNull() & F.col("limit_down_price").isNotNull()
    rules = {
        "null_tradable": F.col("is_tradable").isNull(),
        "negative_listed_days": F.col("listed_days") < 0,
        "negative_listed_trading_days": F.col("listed_trading_days") < 0,
        "tradable_without_valid_price": F.col("is_tradable") & ~F.col("price_valid"),
        "tradable_without_valid_volume": F.col("is_tradable") & ~F.col("volume_valid"),
        "limit_hit_without_limit": ~F.col("has_price_limit") & (F.col("is_limit_up") | F.col("is_limit_down")),
        "limited_without_limit_price": F.col("has_price_limit") & F.col("price_valid") & ~both_limits,
    }
    per_key = state.groupBy("trade_date", "ts_code", "state_version").agg(
        (F.count(F.lit(1)) - 1).alias("duplicate_key"), *[F.count_if(c).alias(name) for name, c in rules.items()]
    )
    totals = per_key.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ["duplicate_key", *rules]])
    return totals.unpivot([], ["duplicate_key", *rules], "check_name", "broken_rows")


def state_totals(state: DataFrame) -> DataFrame:
    return state.agg(
        F.count(F.lit(1)).alias("state_rows"),
        F.count_if("is_st").alias("st_filtered"),
        F.count_if(~F.col("price_valid")).alias("invalid_price_rows"),
        F.count_if("is_suspended").alias("suspended_rows"),
        F.count_distinct("trade_date").alias("trade_dates"),
    )


def query_state(
    state: DataFrame,
    version: str,
    start: str,
    end: str,
    tradable_only: bool = False,
    require_price_valid: bool = False,
    require_volume_valid: bool = False,
    ts_codes: list[str] | None = None,
    pool: DataFrame | None = None,
    columns: list[str] | None = None,
    expected_dates: DataFrame | None = None,
) -> DataFrame:
    """A filtered view of the state table; with ``expected_dates`` an uncovered date is an error."""
    if expected_dates is not None:
        wanted = expected_dates.where(F.col("trade_date").between(start, end))
        gaps = missing_dates(wanted, state.where(F.col("state_version") == version))
        first = [r[0] for r in gaps.orderBy("trade_date").limit(5).collect()]
        if first:
            raise ValueError(f"state does not cover all dates, first missing: {first}")
    rows = state.where((F.col("state_version") == version) & F.col("trade_date").between(start, end))
    if ts_codes:
        rows = rows.where(F.col("ts_code").isin(ts_codes))
    if tradable_only:
        rows = rows.where("is_tradable")
    if require_price_valid:
        rows = rows.where("price_valid")
    if require_volume_valid:
        rows = rows.where("volume_valid")
    if pool is not None:
        rows = members_only(rows, intervals_touching(pool, start, end))
    return rows.select(*(columns or STATE_COLUMNS))


def query_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("trade_date").alias("trade_dates"),
        F.count_distinct("ts_code").alias("ts_codes"),
    )


def affected_dates(raw_files: DataFrame, state_files: DataFrame, version: str) -> DataFrame:
    """Dates to (re)build: none of this version yet, or raw data changed after the state was written.

    ``raw_files``: trade_date, dataset, modified_time; ``state_files``: trade_date, state_version,
    modified_time.
    """
    raw = raw_files.groupBy("trade_date").agg(
        F.max("modified_time").alias("raw_time"), F.count_if(F.col("dataset") == "daily").alias("daily_files")
    )
    built = state_files.groupBy("trade_date").agg(
        F.max("modified_time").alias("state_time"), F.count_if(F.col("state_version") == version).alias("own")
    )
    stale = F.col("own").isNull() | (F.col("own") == 0) | (F.col("raw_time") > F.col("state_time"))
    return raw.where("daily_files > 0").join(built, "trade_date", "left").where(stale).select("trade_date")
