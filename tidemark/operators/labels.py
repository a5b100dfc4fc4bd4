"""Forward-return labels and the look-ahead check."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalars import clip, growth, sdiv
from tidemark.functions.windows import lagged, led, over
from tidemark.operators.ranking import group_quantiles, rank_pct, with_ranks
from tidemark.session import stage

LABEL = "label_rel_return"
LABEL_COLUMNS = ["future_return", "benchmark_future_return", LABEL]


def benchmark_forward(market: DataFrame, benchmark: str, horizon: int = 5) -> DataFrame:
    """The benchmark's return over the next ``horizon`` of its own rows; one row per day."""
    series = market.where(F.col("ts_code") == benchmark).withColumn("close", F.col("close").try_cast("double"))
    return series.select("trade_date", growth(led("close", horizon), "close").alias("benchmark_future_return"))


def add_labels(panel: DataFrame, forward: DataFrame, horizon: int = 5) -> DataFrame:
    """The entity's forward return over its own rows, the benchmark's, and their difference."""
    own = panel.withColumn("future_return", growth(led("close", horizon), "close"))
    joined = own.join(F.broadcast(forward), "trade_date", "left")  # one row per day at most
    return joined.withColumn(LABEL, F.col("future_return") - F.col("benchmark_future_return"))


def forward_labels(panel: DataFrame, forward: dict[int, DataFrame], horizons: Sequence[int] = (1, 5, 10), main: int = 5, top: float = 0.2) -> DataFrame:
    """Label variants per row (date, entity, industry, close): for each horizon h over the entity's following rows 1..h

    - ``y_ret_h`` the return, ``y_up_h`` whether it is positive,
    - ``y_worst_h`` and ``y_best_h`` the lowest and highest close on the way against today's,
    - ``y_risk_h`` the return over the deviation of the h daily returns times the root of h,
    - ``y_excess_h`` and ``y_excess_up_h`` against ``forward[h]``, the benchmark's returns by date,

    and for the ``main`` one within each date ``y_rank`` (percentile rank), ``y_top`` (in the best ``top`` share), ``y_winsor`` (cut at the 1 %
    and 99 % quantiles) and ``y_neutral`` (against the industry's mean). ``known_on_h`` is the day a label is known. A label is null until all h rows are there.
    """
    # the whole panel's windows run on one partitioning and one sort
    step = panel.withColumn("_r", growth("close", lagged("close", 1)))
    following = lambda h: over(f"ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING")
    made = {}
    for h in horizons:
        frame = following(h)
        made |= {f"known_on_{h}": led("trade_date", h), f"y_ret_{h}": growth(led("close", h), "close")}
        mature = F.expr(f"count(*) {frame} = {h} AND count(close) {frame} = {h}")
        made |= {f"y_{name}_{h}": F.when(mature, growth(F.expr(f"{fn}(close) {frame}"), "close")) for name, fn in (("worst", "min"), ("best", "max"))}
        spread = F.expr(f"CASE WHEN count(_r) {frame} = {h} THEN stddev_samp(_r) {frame} END")
        made[f"_risk_{h}"] = spread * F.lit(float(h) ** 0.5)
    out = step.withColumns(made)
    for h in horizons:
        out = out.join(F.broadcast(forward[h].withColumnRenamed("benchmark_future_return", f"_b_{h}")), "trade_date", "left")  # one row per day
    excess = {f"y_excess_{h}": F.col(f"y_ret_{h}") - F.col(f"_b_{h}") for h in horizons}
    risk = {f"y_risk_{h}": sdiv(f"y_ret_{h}", f"_risk_{h}") for h in horizons}
    ups = {f"y_up_{h}": (F.col(f"y_ret_{h}") > 0).cast("int") for h in horizons} | {f"y_excess_up_{h}": (F.col(f"y_ret_{h}") - F.col(f"_b_{h}") > 0).cast("int") for h in horizons}
    out = out.withColumns(excess | risk | ups).drop("_r", *[f"_risk_{h}" for h in horizons], *[f"_b_{h}" for h in horizons])
    out = stage(out, "forward-labels")  # ranks, quantiles and means each read a few columns

    y = f"y_ret_{main}"
    narrow = out.select("trade_date", "ts_code", "industry", F.col(y).alias("y"))
    ranked = with_ranks(narrow.select("trade_date", "ts_code", "y"), ["trade_date"], ["y"], ["ts_code"])
    placed = ranked.select("trade_date", "ts_code", rank_pct("y").alias("y_rank"), (rank_pct("y", ascending=False) <= top).cast("int").alias("y_top"))
    ends = stage(group_quantiles(narrow, ["trade_date"], "y", {"_low": 0.01, "_high": 0.99}, ["ts_code"]), "label-ends")
    means = stage(narrow.groupBy("trade_date", "industry").agg(F.avg("y").alias("_mean")), "label-means")
    joined = out.join(placed, ["trade_date", "ts_code"], "left").join(ends, "trade_date", "left").join(means, ["trade_date", "industry"], "left")
    return joined.withColumns({"y_winsor": clip(y, "_low", "_high"), "y_neutral": F.col(y) - F.col("_mean")}).drop("_low", "_high", "_mean")


def label_leaks(build: Callable[[DataFrame], DataFrame], panel: DataFrame, cutoff: str, labels: dict[str, str]) -> DataFrame:
    """(date, entity, label) where a panel cut off after ``cutoff`` disagrees: a label that is known by then has another value, or one
    that is not known yet has a value. ``labels`` gives the column that tells since when each label is known."""
    pairs = lambda df: df.select(
        "trade_date", "ts_code", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("y"), F.col(k).alias("known_on")) for n, k in labels.items()])).alias("l")
    ).select("trade_date", "ts_code", "l.*")
    full = pairs(build(panel)).withColumn("y", F.when(F.col("known_on") <= cutoff, F.col("y"))).where(F.col("trade_date") <= cutoff)
    cut = pairs(build(panel.where(F.col("trade_date") <= cutoff)))
    both = full.alias("f").join(cut.alias("c"), ["trade_date", "ts_code", "label"])
    return both.where(~F.col("f.y").eqNullSafe(F.col("c.y"))).select("trade_date", "ts_code", "label")


def lookahead_rows(build: Callable[[DataFrame], DataFrame], panel: DataFrame, cutoff: str) -> DataFrame:
    """Feature rows up to ``cutoff`` that change when the panel is cut off there: empty = no look-ahead.

    Of each row only its key and the SHA-256 of its values are moved; the rows of keys whose digests differ are then compared in full.
    """
    keys = ["trade_date", "ts_code"]
    full = build(panel).where(F.col("trade_date") <= cutoff)
    cut = build(panel.where(F.col("trade_date") <= cutoff))
    digest = lambda df, side: df.select(*keys, F.unhex(F.sha2(F.to_json(F.struct(*full.columns)), 256)).alias("digest"), F.lit(side).alias("side"))
    sides = digest(full, 1).unionByName(digest(cut, -1)).groupBy(*keys, "digest").agg(F.sum("side").alias("more"))
    suspects = stage(sides.where("more <> 0").select(*keys).distinct(), "lookahead-suspects")
    if suspects.isEmpty():
        return panel.sparkSession.createDataFrame([], full.schema)

    def kept(df: DataFrame, name: str) -> DataFrame:
        same = functools.reduce(lambda a, b: a & b, [df[k].eqNullSafe(suspects[k]) for k in keys])
        return stage(df.join(suspects, same, "left_semi"), name)

    full, cut = kept(full, "lookahead-full"), kept(cut, "lookahead-cut")
    return full.exceptAll(cut).unionByName(cut.exceptAll(full))
