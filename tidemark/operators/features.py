"""The feature library: row-wise, cross-sectional and rolling features, published one session late.

Three stages, so that data moves as little as possible:

1. ``row_features``: expressions on one row;
2. ``cross_features``: per-date and per-industry values (ranks, means, winsor bounds), computed on narrow
   tables and joined back;
3. ``history_features``: everything over an entity's past, all on one partitioning and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import as_date, clip, flag, growth, sdiv
from tidemark.functions.windows import default_min_obs, over, with_rolled
from tidemark.operators.ranking import group_quantiles, rank_pct, with_ranks
from tidemark.operators.recurrences import macd
from tidemark.session import by_entity, stage

WINDOWS = (5, 10, 20, 60)
KEYS = ["trade_date", "ts_code"]
# The columns clipped to their date's quantiles.
WINSOR_COLUMNS = ["pe_ttm", "pb", "ps_ttm"]
LAG_PREFIX = "lag1_"

# The published base features, in order.
BASE_FEATURES = [
    "ret_1d", "ret_5d", "ret_20d", "amount_log", "vol_log", "log_total_mv", "log_circ_mv", "turnover_rate",
    "turnover_rate_f", "volume_ratio", "pe_ttm_winsor", "pb_winsor", "ps_ttm_winsor", "net_mf_amount_to_amount",
    "large_order_imbalance", "main_mf_strength", "amplitude", "close_position", "upper_shadow_ratio",
    "lower_shadow_ratio", "gap_open", "intraday_return", "benchmark_ret_1d", "excess_ret_1d", "beta_20d", "beta_60d",
    "residual_ret_20d", "residual_ret_60d", "rsi_14d", "macd_diff", "macd_dea", "macd_hist", "ma_ratio_5_20",
    "ma_ratio_20_60", "price_to_ma20", "bollinger_z_20d", "industry_ret_1d_mean", "industry_neutral_ret_1d",
    "industry_neutral_ret_20d", "industry_turnover_rank", "industry_amount_rank", "industry_pb_rank",
    "industry_mv_rank", "is_limit_up", "is_limit_down", "has_price_limit", "limit_ratio", "dist_to_limit_up",
    "dist_to_limit_down", "limit_position", "near_limit_up_2pct", "near_limit_down_2pct", "limit_touch_up",
    "limit_touch_down", "listed_trading_days", "industry_net_mf_strength_mean", "industry_net_mf_strength_rank",
    "industry_net_mf_positive_ratio", "amount_rank_pct", "turnover_cost_proxy", "illiquidity_proxy",
    "max_drawdown_20d", "new_high_20d", "turnover_acceleration", "weekday", "month", "is_month_end",
]
# The state columns that features read.
STATE_INPUTS = [
    "is_limit_up", "is_limit_down", "has_price_limit", "limit_ratio", "limit_up_price", "limit_down_price",
    "listed_trading_days",
]
# The published rolling features, one for each window.
ROLLING_FAMILIES = [
    "ret_{n}d_mean", "ret_{n}d_std", "amount_{n}d_mean", "turnover_{n}d_mean", "turnover_{n}d_std",
    "net_mf_strength_{n}d_mean", "excess_ret_{n}d_mean",
]


def published_features(windows: Sequence[int] = WINDOWS) -> list[str]:
    return [*BASE_FEATURES, *[f.format(n=n) for f in ROLLING_FAMILIES for n in windows]]


# --- stage 1: one row -------------------------------------------------------------------------------


def row_features(panel: DataFrame) -> DataFrame:
    """Features of a single row; limit features only where the panel carries limit prices."""
    up0 = F.greatest(F.coalesce("amount", F.lit(0.0)), F.lit(0.0))
    vol0 = F.greatest(F.coalesce("vol", F.lit(0.0)), F.lit(0.0))
    body_high, body_low = F.greatest("open", "close"), F.least("open", "close")
    day = as_date("trade_date")
    bought, sold = F.col("buy_lg_amount"), F.col("sell_lg_amount")
    out = panel.withColumns(
        {
            "ret_1d": growth("close", "pre_close"),
            "amount_log": F.log1p(up0),
            "vol_log": F.log1p(vol0),
            "log_total_mv": F.log1p(clip("total_mv", low=F.lit(0.0))),
            "log_circ_mv": F.log1p(clip("circ_mv", low=F.lit(0.0))),
            "net_mf_amount_to_amount": sdiv("net_mf_amount", "amount"),
            "large_order_imbalance": sdiv(bought - sold, bought + sold),
            "main_mf_strength": sdiv(bought - sold, "amount"),
            "amplitude": sdiv(F.col("high") - F.col("low"), "pre_close"),
            "close_position": sdiv(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
            # like a row-wise max/min that skips nulls: open or close alone still gives a body
            "upper_shadow_ratio": sdiv(F.col("high") - body_high, "pre_close"),
            "lower_shadow_ratio": sdiv(body_low - F.col("low"), "pre_close"),
            "gap_open": growth("open", "pre_close"),
            "intraday_return": growth("close", "open"),
            "weekday": F.weekday(day),
            "month": F.month(day),
            "is_month_end": day == F.last_day(day),
        }
    ).withColumns(
        {
            "turnover_cost_proxy": sdiv("turnover_rate", "amount_log"),
            "illiquidity_proxy": sdiv(F.abs("ret_1d"), "amount"),
        }
    )
    if "limit_up_price" not in panel.columns:
        return out
    up, down = F.col("limit_up_price"), F.col("limit_down_price")
    return out.withColumns(
        {
            "dist_to_limit_up": growth(up, "close"),
            "dist_to_limit_down": growth("close", down),
            "limit_position": sdiv(F.col("close") - down, up - down),
            "limit_touch_up": flag(F.col("high") >= up),
            "limit_touch_down": flag(F.col("low") <= down),
        }
    ).withColumns(
        {
            "near_limit_up_2pct": flag(F.col("dist_to_limit_up") <= 0.02),
            "near_limit_down_2pct": flag(F.col("dist_to_limit_down") <= 0.02),
        }
    )


# --- stage 2: one date ------------------------------------------------------------------------------


def benchmark_returns(market: DataFrame, benchmark: str) -> DataFrame:
    """The benchmark's daily return: one row per day."""
    return market.where(F.col("ts_code") == benchmark).select(
        "trade_date", growth(F.col("close").try_cast("double"), F.col("pre_close").try_cast("double")).alias("benchmark_ret_1d")
    )


def with_benchmark(df: DataFrame, returns: DataFrame) -> DataFrame:
    joined = df.join(F.broadcast(returns), "trade_date", "left")  # one row per day at most
    return joined.withColumn("excess_ret_1d", F.col("ret_1d") - F.col("benchmark_ret_1d"))


def _stacked(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Narrow rows (which, trade_date, grp, ts_code, value): ``groups`` maps a grouping column to the value
    columns ranked inside it ('' = the whole date). Rows without a group drop out, as they have no rank."""
    cells = []
    for group, columns in groups.items():
        grp = F.lit("") if group == "" else F.col(group).cast("string")
        cells += [
            F.struct(
                F.lit(f"{group}|{c}").alias("which"), grp.alias("grp"), F.col(c).cast("double").alias("value")
            )
            for c in columns
        ]
    long = df.select(*KEYS, F.explode(F.array(*cells)).alias("cell")).select(*KEYS, "cell.*")
    return long.where(F.col("grp").isNotNull() & F.col("value").isNotNull())


def cross_rank_pct(df: DataFrame, ranks: dict[str, tuple[str, str]]) -> DataFrame:
    """Percentile ranks as a narrow table keyed by (date, entity): ``ranks`` maps an output name to
    (grouping column or '', value column)."""
    groups: dict[str, list[str]] = {}
    for group, value in ranks.values():
        groups.setdefault(group, []).append(value)
    ranked = with_ranks(_stacked(df, groups), ["which", "trade_date", "grp"], ["value"], ["ts_code"])
    scored = ranked.select(*KEYS, "which", rank_pct("value").alias("pct"))
    return scored.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("which") == f"{group}|{value}", F.col("pct"))).alias(name) for name, (group, value) in ranks.items()]
    )


def winsor_bounds(df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Per date: ``<c>_low`` and ``<c>_high`` for every column."""
    bounds = group_quantiles(
        _stacked(df, {"": columns}), ["which", "trade_date"], "value", {"low": lower, "high": upper}, ["ts_code"]
    )
    return bounds.groupBy("trade_date").agg(
        *[
            F.max(F.when(F.col("which") == f"|{c}", F.col(side))).alias(f"{c}_{side}")
            for c in columns
            for side in ("low", "high")
        ]
    )


def with_winsor(df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Add ``<c>_winsor``: each column clipped to its date's quantiles."""
    present = [c for c in columns if c in df.columns]
    # one row per date, stored because ranks of clipped columns read it several times
    bounds = stage(winsor_bounds(df, present, lower, upper), "winsor")
    joined = df.join(bounds, "trade_date", "left")
    clipped = {f"{c}_winsor": clip(c, F.col(f"{c}_low"), F.col(f"{c}_high")) for c in present}
    return joined.withColumns(clipped).drop(*[f"{c}_{s}" for c in present for s in ("low", "high")])


INDUSTRY_RANKS = {
    "industry_turnover_rank": ("industry", "turnover_rate"),
    "industry_amount_rank": ("industry", "amount"),
    "industry_pb_rank": ("industry", "pb_winsor"),
    "industry_mv_rank": ("industry", "circ_mv"),
    "industry_net_mf_strength_rank": ("industry", "net_mf_amount_to_amount"),
}
DATE_RANKS = {"amount_rank_pct": ("", "amount")}


def industry_means(df: DataFrame) -> DataFrame:
    flow = F.col("net_mf_amount_to_amount")
    return df.where(F.col("industry").isNotNull()).groupBy("trade_date", "industry").agg(
        F.avg("ret_1d").alias("industry_ret_1d_mean"),
        F.avg(flow).alias("industry_net_mf_strength_mean"),
        F.avg(F.when(flow > 0, 1.0).otherwise(0.0)).alias("industry_net_mf_positive_ratio"),
    )


def with_industry_means(df: DataFrame) -> DataFrame:
    # stored, so the join knows its size and need not move the panel by (date, industry)
    means = stage(industry_means(df), "industry-means")
    joined = df.join(means, ["trade_date", "industry"], "left")
    return joined.withColumn("industry_neutral_ret_1d", F.col("ret_1d") - F.col("industry_ret_1d_mean"))


def cross_features(df: DataFrame, returns: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """Cross-sectional features; winsor bounds and ranks only for ``wanted`` names (all by default)."""
    all_ranks = {**DATE_RANKS, **INDUSTRY_RANKS}
    ranks = {n: r for n, r in all_ranks.items() if wanted is None or n in wanted}
    needed = {c for _, c in ranks.values()} | (wanted or set())
    clipped = [c for c in WINSOR_COLUMNS if wanted is None or f"{c}_winsor" in needed]
    clean = with_winsor(df, clipped) if clipped else df
    out = with_industry_means(with_benchmark(clean, returns))
    if not ranks:
        return out
    return by_entity(out).join(cross_rank_pct(clean, ranks), KEYS, "left")


# --- stage 3: one entity's history ------------------------------------------------------------------


def with_macd(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add macd_diff, macd_dea and macd_hist.

    The recurrences run on (entity, date, close) alone, by default of ``df``; ``prices`` gives those columns where ``df`` is wide and costly.
    """
    narrow = by_entity((df if prices is None else prices).select(*KEYS, "close"))
    return df.join(macd(narrow), KEYS, "left")


@dataclass(frozen=True)
class Block:
    """Features over an entity's past: SQL of helper inputs, rolling columns (fn, column, n, min_obs), and SQL
    of the outputs made from them. Names that start with '_' are not kept."""

    inputs: dict[str, str] = field(default_factory=dict)
    rolled: dict[str, tuple[str, str, int, int]] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)


def with_blocks(df: DataFrame, *blocks: Block) -> DataFrame:
    """Evaluate blocks together, so that they share windows and one sort."""
    inputs, rolled, outputs = ({k: v for b in blocks for k, v in getattr(b, part).items()} for part in ("inputs", "rolled", "outputs"))
    out = df.withColumns({k: F.expr(e) for k, e in inputs.items()}) if inputs else df
    out = with_rolled(out, rolled)
    if outputs:
        out = out.withColumns({k: F.expr(e) for k, e in outputs.items()})
    return out.drop(*[k for k in [*inputs, *rolled] if k.startswith("_")])


def _growth(a: str, b: str) -> str:
    return f"(try_divide({a}, {b}) - 1)"


PRICES = Block(
    rolled={
        "_ma5": ("avg", "close", 5, 3),
        "_ma20": ("avg", "close", 20, 10),
        "_ma60": ("avg", "close", 60, 30),
        "_sd20": ("stddev_samp", "close", 20, 10),
        "_peak20": ("max", "close", 20, 10),
    },
    outputs={
        "ret_5d": _growth("close", f"lag(close, 5) {over()}"),
        "ret_20d": _growth("close", f"lag(close, 20) {over()}"),
        "ma_ratio_5_20": _growth("_ma5", "_ma20"),
        "ma_ratio_20_60": _growth("_ma20", "_ma60"),
        "price_to_ma20": _growth("close", "_ma20"),
        "bollinger_z_20d": "try_divide(close - _ma20, _sd20)",
        "max_drawdown_20d": _growth("close", "_peak20"),
        "new_high_20d": "CAST(coalesce(close >= _peak20, false) AS INT)",
    },
)
RSI = Block(
    inputs={
        "_gain": "CASE WHEN ret_1d IS NOT NULL THEN greatest(ret_1d, 0D) END",
        "_loss": "CASE WHEN ret_1d IS NOT NULL THEN greatest(-ret_1d, 0D) END",
    },
    rolled={"_up14": ("avg", "_gain", 14, 7), "_down14": ("avg", "_loss", 14, 7)},
    outputs={"rsi_14d": "100 - try_divide(100D, 1 + try_divide(_up14, _down14))"},
)
TURNOVER = Block(
    rolled={"_turnover20": ("avg", "turnover_rate", 20, 10)},
    outputs={"turnover_acceleration": _growth("turnover_rate", "_turnover20")},
)
INDUSTRY = Block(rolled={"industry_neutral_ret_20d": ("avg", "industry_neutral_ret_1d", 20, 10)})
_ROLLED_FROM = {
    "ret_{n}d_mean": ("avg", "ret_1d"),
    "ret_{n}d_std": ("stddev_samp", "ret_1d"),
    "amount_{n}d_mean": ("avg", "amount"),
    "turnover_{n}d_mean": ("avg", "turnover_rate"),
    "turnover_{n}d_std": ("stddev_samp", "turnover_rate"),
    "net_mf_strength_{n}d_mean": ("avg", "net_mf_amount_to_amount"),
    "excess_ret_{n}d_mean": ("avg", "excess_ret_1d"),
}


def rolling_block(windows: Sequence[int] = WINDOWS, families: Sequence[str] = tuple(ROLLING_FAMILIES)) -> Block:
    return Block(rolled={f.format(n=n): (*_ROLLED_FROM[f], n, default_min_obs(n)) for f in families for n in windows})


def beta_block(windows: Sequence[int] = (20, 60)) -> Block:
    """Rolling slope on the benchmark and the residual; each moment has its own count of non-null values."""
    inputs = {"_xy": "benchmark_ret_1d * ret_1d", "_xx": "benchmark_ret_1d * benchmark_ret_1d"}
    rolled, outputs = {}, {}
    for n in windows:
        for name, source in {"x": "benchmark_ret_1d", "y": "ret_1d", "xy": "_xy", "xx": "_xx"}.items():
            rolled[f"_m{name}{n}"] = ("avg", source, n, max(10, n // 2))
        slope = f"try_divide(_mxy{n} - _mx{n} * _my{n}, _mxx{n} - _mx{n} * _mx{n})"
        outputs[f"beta_{n}d"] = slope
        outputs[f"residual_ret_{n}d"] = f"ret_1d - {slope} * benchmark_ret_1d"
    return Block(inputs, rolled, outputs)


def history_features(df: DataFrame, windows: Sequence[int] = WINDOWS, with_recurrences: bool = True, prices: DataFrame | None = None) -> DataFrame:
    out = with_macd(df, prices) if with_recurrences else df
    return with_blocks(out, PRICES, RSI, TURNOVER, INDUSTRY, rolling_block(windows), beta_block())


# --- the whole library ------------------------------------------------------------------------------


def add_features(
    panel: DataFrame, returns: DataFrame, windows: Sequence[int] = WINDOWS, wanted: Sequence[str] | None = None
) -> DataFrame:
    """The feature library; windows run over the rows of ``panel`` as given.

    With ``wanted`` the joins and folds no wanted feature needs are left out (unused window columns are
    pruned by the optimizer anyway).
    """
    names = None if wanted is None else set(wanted)
    recurrent = names is None or any(n.startswith("macd_") for n in names)
    return history_features(cross_features(row_features(panel), returns, names), windows, recurrent, panel)


def lag_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Shift every feature by one row of its entity; only the shifted columns are published."""
    present = [c for c in features if c in df.columns]
    names = [f"{LAG_PREFIX}{c}" for c in present]
    shifted = [f"lag(CAST(`{c}` AS DOUBLE), 1) {over()} AS `{n}`" for c, n in zip(present, names)]
    return df.selectExpr(*KEYS, *keep, *shifted), names
