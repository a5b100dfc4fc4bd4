"""From raw panel tables to the feature and label mart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.features import (
    KEYS, STATE_INPUTS, WINDOWS, add_features, benchmark_returns, lag_features, published_features,
)
from tidemark.operators.labels import LABEL, LABEL_COLUMNS, add_labels, benchmark_forward
from tidemark.operators.membership import members_only
from tidemark.operators.panel import attach, latest
from tidemark.operators.state import query_state
from tidemark.session import by_entity, stage

METRIC_COLUMNS = [
    "turnover_rate", "turnover_rate_f", "volume_ratio", "pe_ttm", "pb", "ps_ttm", "total_mv", "circ_mv",
]
FLOW_COLUMNS = ["net_mf_amount", "net_mf_vol", "buy_lg_amount", "sell_lg_amount"]


def _one_a_day(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per key: the last ingested, then the one of greatest values. All histories rest on this."""
    recency = [c for c in ("ingested_at",) if c in df.columns]
    carried = [c for c in columns if c not in recency]
    kept = latest(by_entity(df).select(*KEYS, *recency, *carried), KEYS, [*recency, *carried])
    return kept.select(*KEYS, *columns)


def base_panel(
    daily: DataFrame,
    metric: DataFrame,
    moneyflow: DataFrame,
    basic: DataFrame,
    start: str,
    end: str,
    pool: DataFrame | None = None,
) -> DataFrame:
    """Prices with valuation, money flow and dimension columns; dates filtered before any join."""
    wanted = ((daily, [c for c in daily.columns if c not in KEYS]), (metric, METRIC_COLUMNS), (moneyflow, FLOW_COLUMNS))
    ranged = [_one_a_day(df.where(F.col("trade_date").between(start, end)), columns) for df, columns in wanted]
    dim = latest(
        basic.select("ts_code", "industry", "market", "list_date"), ["ts_code"], ["list_date", "industry", "market"]
    ).fillna("UNKNOWN", ["industry", "market"])
    panel = attach(ranged[0], ranged[1], KEYS, METRIC_COLUMNS)
    panel = attach(panel, ranged[2], KEYS, FLOW_COLUMNS)
    panel = attach(panel, dim, ["ts_code"], ["industry", "market", "list_date"])
    return panel if pool is None else members_only(panel, pool)


def with_tradable_state(
    panel: DataFrame, state: DataFrame, version: str, start: str, end: str, pool: DataFrame | None = None
) -> DataFrame:
    """Keep tradable rows (of pool members) and add their limit columns."""
    tradable = query_state(
        state, version, start, end, tradable_only=True, pool=pool, columns=[*KEYS, *STATE_INPUTS]
    )
    return panel.join(tradable, KEYS, "inner")


def build_mart(
    panel: DataFrame,
    market: DataFrame,
    benchmark: str,
    horizon: int = 5,
    windows: Sequence[int] = WINDOWS,
    features: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """All published features (one session late) and labels of a tradable panel.

    The joined panel is stored first: winsor bounds, ranks and histories each read a few of its columns.
    """
    panel = stage(panel, "panel")
    featured = add_features(panel, benchmark_returns(market, benchmark), windows, features)
    labelled = add_labels(featured, benchmark_forward(market, benchmark, horizon), horizon)
    return lag_features(labelled, features or published_features(windows), keep=LABEL_COLUMNS)


def write_mart(mart: DataFrame, lagged: Sequence[str], root: str, version: str) -> dict[str, str]:
    """Features, labels and the labelled dataset as three tables."""
    paths = {name: f"{root}/{name}_{version}" for name in ("features", "labels", "dataset")}
    whole = stage(mart, "mart")  # computed once, projected three times
    whole.select(*KEYS, *lagged).write.mode("overwrite").parquet(paths["features"])
    whole.select(*KEYS, *LABEL_COLUMNS).write.mode("overwrite").parquet(paths["labels"])
    whole.dropna(subset=[LABEL]).select(*KEYS, *lagged, *LABEL_COLUMNS).write.mode("overwrite").parquet(paths["dataset"])
    return paths


def mart_summary(mart: DataFrame, lagged: Sequence[str], horizon: int) -> DataFrame:
    return mart.agg(F.count(F.lit(1)).alias("features_rows"), F.count(LABEL).alias("dataset_rows")).select(
        "*", F.lit(len(lagged)).alias("feature_columns"), F.lit(horizon).alias("label_horizon")
    )
