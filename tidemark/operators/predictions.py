"""Scoring of predictions per split: errors, daily correlation and its stability, area under the ROC curve.

Ranks over a whole split are taken on the ranking engine's buckets, so no task holds a split. The area is the
rank-sum statistic with ties at their average rank; sums of ranks are multiples of one half, so they are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalars import finite, sdiv
from tidemark.operators.ranking import average_rank, with_ranks
from tidemark.session import stage


def _complete(df: DataFrame, prediction: str, label: str, split: str) -> DataFrame:
    rows = df.select(F.col(split).alias("split"), "trade_date", "ts_code", finite(prediction).alias("p"), finite(label).alias("y"))
    return rows.where(F.col("split").isNotNull() & F.col("p").isNotNull() & F.col("y").isNotNull())


def daily_scores(rows: DataFrame, min_cross_section: int = 30) -> DataFrame:
    """(split, trade_date, ic, rank_ic, n) of complete rows (split, trade_date, ts_code, p, y)."""
    ranked = with_ranks(rows, ["split", "trade_date"], ["p", "y"], ["ts_code"]).where(F.col("p__n") >= min_cross_section)
    ranks = ranked.select("split", "trade_date", "p", "y", average_rank("p").alias("rp"), average_rank("y").alias("ry"))
    pearson = lambda a, b: sdiv(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return ranks.groupBy("split", "trade_date").agg(pearson("p", "y").alias("ic"), pearson("rp", "ry").alias("rank_ic"), F.count(F.lit(1)).alias("n"))


def areas_under_curve(rows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(split, positives, negatives, auc): how often a row with a label above ``threshold`` is predicted higher than one without;
    null where a split has one class only."""
    ranked = with_ranks(rows, ["split"], ["p"], ["trade_date", "ts_code"])
    up = F.col("y") > threshold
    sums = ranked.groupBy("split").agg(F.count_if(up).alias("positives"), F.count_if(~up).alias("negatives"), F.sum(F.when(up, average_rank("p"))).alias("_rank_sum"))
    n = F.col("positives").cast("double")
    area = sdiv(F.col("_rank_sum") - n * (n + 1) / 2.0, n * F.col("negatives"))
    return sums.select("split", "positives", "negatives", area.alias("auc"))


def score(df: DataFrame, prediction: str, label: str, split: str = "split", min_cross_section: int = 30, threshold: float = 0.0) -> DataFrame:
    """One row per split over rows with a prediction and a label: rows, mse, mae, accuracy of the sign against ``threshold``,
    mean and deviation of the daily correlations, their ratio (icir, rank_icir), days, and the area under the curve."""
    rows = stage(_complete(df, prediction, label, split), "predictions")
    error = F.col("p") - F.col("y")
    same_side = (F.col("p") > threshold) == (F.col("y") > threshold)
    errors = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(same_side.cast("double")).alias("accuracy"),
    )
    daily = daily_scores(rows, min_cross_section)
    stats = daily.groupBy("split").agg(
        F.count("rank_ic").alias("days"),
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("ic_std"),
        sdiv(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"),
        sdiv(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_icir"),
    )
    out = errors.join(stats, "split", "left").join(areas_under_curve(rows, threshold), "split", "left")
    return out.withColumn("days", F.coalesce("days", F.lit(0).cast("long")))
