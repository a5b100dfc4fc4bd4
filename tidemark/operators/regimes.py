"""Market regimes from the benchmark series and reports sliced by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalars import growth
from tidemark.functions.windows import lagged, rolling, rolling_rank_pct
from tidemark.operators.factors import ic_summary, quantile_spread


def regime_source(market: DataFrame, benchmark: str) -> DataFrame:
    """Trailing return, volatility and amount rank of the benchmark; one row per day."""
    series = market.where(F.col("ts_code") == benchmark).select(
        "ts_code", "trade_date", *[F.col(c).try_cast("double").alias(c) for c in ("close", "pre_close", "amount")]
    )
    series = series.withColumn("ret", growth("close", "pre_close"))
    return series.select(
        "trade_date",
        growth("close", lagged("close", 20)).alias("benchmark_ret_20d"),
        growth("close", lagged("close", 60)).alias("benchmark_ret_60d"),
        rolling("stddev_samp", "ret", 20, 10).alias("benchmark_vol_20d"),
        rolling_rank_pct("amount", 60, 20).alias("benchmark_amount_rank_60d"),
    )


def label_regimes(source: DataFrame) -> DataFrame:
    """(date, market_regime): high_vol, bull, bear or sideways by terciles over the whole series.

    The series has one row per day, so its exact percentiles are one small aggregation.
    """
    cut = source.agg(
        F.percentile("benchmark_vol_20d", F.lit(2 / 3)).alias("vol_high"),
        F.percentile("benchmark_ret_20d", F.lit(2 / 3)).alias("ret_high"),
        F.percentile("benchmark_ret_20d", F.lit(1 / 3)).alias("ret_low"),
    )
    joined = source.join(F.broadcast(cut))  # one row
    return joined.select(
        "trade_date",
        F.when(F.col("benchmark_vol_20d") >= F.col("vol_high"), "high_vol")
        .when(F.col("benchmark_ret_20d") >= F.col("ret_high"), "bull")
        .when(F.col("benchmark_ret_20d") <= F.col("ret_low"), "bear")
        .otherwise("sideways")
        .alias("market_regime"),
    )


def with_regime(df: DataFrame, regimes: DataFrame) -> DataFrame:
    """Attach the regime; dates the benchmark does not have get null."""
    return df.join(F.broadcast(regimes), "trade_date", "left")  # one row per day at most


def regime_ic_summary(daily_ic: DataFrame, regimes: DataFrame, features: Sequence[str]) -> DataFrame:
    sliced = with_regime(daily_ic, regimes).where(F.col("market_regime").isNotNull())
    return ic_summary(sliced, features, ["market_regime"])


def regime_quantile_spread(
    df: DataFrame, regimes: DataFrame, features: Sequence[str], label: str, quantiles: int = 5, min_cross_section: int = 30
) -> DataFrame:
    sliced = with_regime(df, regimes).where(F.col("market_regime").isNotNull())
    return quantile_spread(sliced, features, label, quantiles, min_cross_section, ["market_regime"])
