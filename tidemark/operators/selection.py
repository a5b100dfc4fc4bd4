"""Feature recommendations: score, gates, and a greedy pass that avoids correlated picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Name parts of features kept for sequence models, and groups of near-duplicates.
SEQUENCE_ONLY = [
    "month", "weekday", "benchmark_ret", "beta_", "residual_ret", "macd_", "rsi_", "bollinger_", "ma_ratio", "price_to_ma",
]
NEAR_DUPLICATES = [
    ["lag1_ret_5d", "lag1_ret_5d_mean"],
    ["lag1_ret_20d", "lag1_ret_20d_mean"],
    ["lag1_large_order_imbalance", "lag1_main_mf_strength"],
    ["lag1_price_to_ma20", "lag1_bollinger_z_20d"],
    ["lag1_macd_diff", "lag1_macd_dea", "lag1_macd_hist"],
    ["lag1_dist_to_limit_up", "lag1_dist_to_limit_down", "lag1_ret_1d"],
]
# The limits of the recommendation gates.
MAX_MISSING, MIN_UNIQUE = 0.35, 5
MIN_RANK_IC, MIN_SPREAD, MIN_T = 0.015, 0.006, 2.0


def scored_features(features: Sequence[str], ic: DataFrame, spread: DataFrame, quality: DataFrame) -> DataFrame:
    """One row per feature with its report columns and score."""
    spark = ic.sparkSession
    base = spark.createDataFrame([(f,) for f in features], "feature string")
    ls = ["long_short_mean_return", "long_short_t_stat", "long_short_win_ratio", "long_short_max_drawdown"]
    table = (
        base.join(ic, "feature", "left")
        .join(spread.select("feature", *ls), "feature", "left")
        .join(quality.select("feature", "missing_ratio", "unique_values"), "feature", "left")
    )
    zero = F.lit(0.0)
    score = (
        F.coalesce(F.abs("rank_ic_mean"), zero) * 100
        + F.coalesce(F.abs("long_short_mean_return"), zero) * 100
        + F.coalesce("long_short_win_ratio", zero) * 0.5
        - F.coalesce("missing_ratio", F.lit(1.0)) * 0.5
    )
    return table.withColumn("score", score)


def _group_number(groups: Sequence[Sequence[str]]) -> Column:
    out = F.lit(None).cast("int")
    for i, names in enumerate(groups):
        out = F.when(F.col("feature").isin(list(names)), i).otherwise(out)
    return out


def recommend(
    scored: DataFrame,
    correlations: DataFrame,
    max_corr: float = 0.85,
    sequence_only: Sequence[str] = SEQUENCE_ONLY,
    near_duplicates: Sequence[Sequence[str]] = NEAR_DUPLICATES,
) -> DataFrame:
    """Classify every feature as baseline, advanced or drop, with the reason.

    The fixed gates are expressions. The last one depends on the picks made before, so the candidates (one
    row per configured feature) are folded in score order.
    """
    grouped = scored.withColumn("_group", _group_number(near_duplicates))
    best_first = Window.partitionBy("_group").orderBy(F.desc("score"), "feature")
    grouped = grouped.withColumn("_winner", F.when(F.col("_group").isNotNull(), F.first("feature").over(best_first)))
    reserved = F.lit(False)
    for part in sequence_only:
        reserved = reserved | F.col("feature").contains(part)
    strong = (
        F.coalesce(F.abs("rank_ic_mean") >= MIN_RANK_IC, F.lit(False))
        | F.coalesce(F.abs("long_short_mean_return") >= MIN_SPREAD, F.lit(False))
        | F.coalesce(F.abs("long_short_t_stat") >= MIN_T, F.lit(False))
    )
    gate = (
        F.when(
            F.col("missing_ratio").isNull() | (F.col("missing_ratio") > MAX_MISSING) | (F.col("unique_values") < MIN_UNIQUE),
            "low",
        )
        .when(reserved, "reserved")
        .when(F.col("_winner").isNotNull() & (F.col("_winner") != F.col("feature")), "duplicate")
        .when(F.col("rank_ic_mean").isNull() & F.col("long_short_mean_return").isNull(), "no_signal")
        .when(strong, "candidate")
        .otherwise("weak")
    )
    gated = grouped.withColumn("_gate", gate)
    strong_pairs = correlations.where(F.abs("spearman_corr") >= max_corr)
    both_ways = strong_pairs.select(F.col("feature_left").alias("a"), F.col("feature_right").alias("b")).unionByName(
        strong_pairs.select(F.col("feature_right").alias("a"), F.col("feature_left").alias("b"))
    )
    near = both_ways.groupBy("a").agg(F.collect_set("b").alias("near"))
    none = F.array().cast("array<string>")
    candidates = (
        gated.where(F.col("_gate") == "candidate")
        .join(near, F.col("feature") == F.col("a"), "left")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "feature", F.coalesce("near", none).alias("near")))).alias("list"))
    )
    start = F.struct(none.alias("picked"), F.array().cast("array<struct<feature:string,blocker:string>>").alias("seen"))

    def visit(state: Column, c: Column) -> Column:
        # picked features are kept in pick order; the first correlated one is the reason
        blocker = F.filter(state["picked"], lambda p: F.array_contains(c["near"], p))
        blocked = F.size(blocker) > 0
        entry = F.struct(
            c["feature"].alias("feature"),
            F.when(blocked, F.try_element_at(blocker, F.lit(1))).alias("blocker"),
        )
        picked = F.when(blocked, state["picked"]).otherwise(F.concat(state["picked"], F.array(c["feature"])))
        return F.struct(picked.alias("picked"), F.concat(state["seen"], F.array(entry)).alias("seen"))

    verdicts = candidates.select(F.inline(F.aggregate("list", start, visit, lambda s: s["seen"])))
    out = gated.join(F.broadcast(verdicts), "feature", "left")  # one row per configured feature
    is_gate = lambda g: F.col("_gate") == g
    blocked = F.col("blocker").isNotNull()
    return out.select(
        *scored.columns,
        F.when(is_gate("low") | is_gate("no_signal"), "drop")
        .when(is_gate("candidate") & ~blocked, "baseline")
        .otherwise("advanced")
        .alias("recommendation"),
        F.when(is_gate("low"), F.lit("low_coverage_or_low_variation"))
        .when(is_gate("reserved"), F.lit("reserved_for_advanced_or_sequence_model"))
        .when(is_gate("duplicate"), F.concat(F.lit("pruned_by_collinearity_group:"), "_winner"))
        .when(is_gate("no_signal"), F.lit("no_validation_signal"))
        .when(is_gate("weak"), F.lit("weak_but_potential_sequence_signal"))
        .when(blocked, F.concat(F.lit("correlated_with_baseline:"), "blocker"))
        .otherwise(F.lit("stable_cross_section_signal"))
        .alias("reason"),
    )
