"""Descriptive tables of a panel: histograms, members and industries per day, running sums of daily correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalars import finite, sdiv
from tidemark.session import stage


def histogram(df: DataFrame, values: Sequence[str], bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by.., column, bin, low, high, rows) with equal-width bins 0..``bins``-1 over each column's span, the same for all groups.

    The span comes from one pass of minima and maxima, the counts from a second; both merge in any order. The largest value belongs to the last
    bin; a column with one value has one bin. Missing and non-finite values are counted as bin -1, without edges. Empty bins have no row.
    """
    by = list(by)
    if bins < 1:
        raise ValueError("a histogram has at least one bin")
    long = df.select(*by, *[finite(v).alias(v) for v in values]).unpivot(by, list(values), "column", "x")
    spans = long.groupBy("column").agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    spans = stage(spans.withColumn("_width", (F.col("_high") - F.col("_low")) / bins), "histogram-spans")  # one row per column
    placed = long.join(F.broadcast(spans), "column")
    inside = F.least(F.floor(F.coalesce(sdiv(F.col("x") - F.col("_low"), F.col("_width")), F.lit(0.0))), F.lit(bins - 1))
    counted = placed.groupBy(*by, "column", F.when(F.col("x").isNull(), -1).otherwise(inside).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    known = F.col("bin") >= 0
    low, width = F.col("_low"), F.col("_width")
    edges = [F.when(known, low + F.col("bin") * width).alias("low"), F.when(known, low + (F.col("bin") + 1) * width).alias("high")]
    return counted.join(F.broadcast(spans), "column").select(*by, "column", "bin", *edges, "rows")


def group_sizes(df: DataFrame, by: Sequence[str], share_within: Sequence[str] = ()) -> DataFrame:
    """(by.., rows, entities, share): sizes of groups, such as industries per day, and their share of the rows that agree in ``share_within``."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ts_code").alias("entities"))
    if not share_within:
        return sizes
    # one row per group: a short window
    whole = F.sum("rows").over(Window.partitionBy(*share_within))
    return sizes.withColumn("share", F.col("rows") / whole)


def cumulative_ic(daily: DataFrame) -> DataFrame:
    """Daily correlations (trade_date, feature, ic, rank_ic) with their running sums; a day without one adds nothing."""
    so_far = Window.partitionBy("feature").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).over(so_far).alias(f"cumulative_{c}")
    return daily.select("trade_date", "feature", total("ic"), total("rank_ic"))
