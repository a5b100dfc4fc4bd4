"""The factor reports of one labelled dataset, by stage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import factors, regimes, selection
from tidemark.operators.state import query_summary
from tidemark.session import stage
from tidemark.sources.tables import write_report

# The report stages.
STAGES = ["ic", "quality", "correlation", "quantile", "extended-quantile", "neutralized", "regime-ic", "recommendation"]


@dataclass(frozen=True)
class ReportSettings:
    label: str = "label_rel_return"
    quantiles: int = 5
    min_cross_section: int = 30
    max_corr: float = 0.85
    train_end: str | None = None
    eval_start: str | None = None


def recommendation(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    quantiles: int,
    min_cross_section: int,
    max_corr: float,
    known: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Reports of ``df`` joined, scored and classified; ``df`` should be a stored table.

    ``known`` holds stored reports over the same rows (``ic``, ``spread``, ``quality``, ``pairs``), which are then not made again.
    """
    known = known or {}
    ic = known["ic"] if "ic" in known else factors.ic_summary(factors.daily_ic(df, features, label, min_cross_section), features)
    spread = known["spread"] if "spread" in known else factors.quantile_spread(df, features, label, quantiles, min_cross_section)
    scored = selection.scored_features(features, ic, spread, known["quality"] if "quality" in known else factors.quality(df, features))
    pairs = known["pairs"] if "pairs" in known else factors.correlation_pairs(df, features, top_n=None)
    # the scores are consumed several times; the table has one row per feature
    return selection.recommend(stage(scored, "scores"), pairs, max_corr)


def windows(df: DataFrame, train_end: str | None, eval_start: str | None) -> tuple[DataFrame, DataFrame]:
    """The training rows and the evaluation rows; an empty window is an error."""
    train = df if train_end is None else df.where(F.col("trade_date") <= train_end)
    judge = df if eval_start is None else df.where(F.col("trade_date") >= eval_start)
    for name, part in (("training", train), ("evaluation", judge)):
        if part.isEmpty():
            raise ValueError(f"the {name} window is empty")
    return train, judge


def holdout(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    train_end: str | None,
    eval_start: str | None,
    quantiles: int = 5,
    min_cross_section: int = 30,
    max_corr: float = 0.85,
) -> DataFrame:
    """Spreads on the evaluation window of the features the training window kept."""
    train, judge = windows(df, train_end, eval_start)
    classes = recommendation(train, features, label, quantiles, min_cross_section, max_corr)
    return holdout_spread(judge, classes, features, label, quantiles, min_cross_section)


def holdout_spread(
    judge: DataFrame, classes: DataFrame, features: Sequence[str], label: str, quantiles: int, min_cross_section: int
) -> DataFrame:
    kept = classes.where(F.col("recommendation").isin("baseline", "advanced")).select("feature")
    names = {r[0] for r in kept.collect()}  # feature names only
    chosen = [f for f in features if f in names]
    return factors.quantile_spread(judge, chosen, label, quantiles, min_cross_section)


def class_summary(classes: DataFrame, held: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(section, place, feature, value): the features of each class by score, then the ``top`` features by absolute rank
    IC, by absolute spread and, with ``held``, by absolute hold-out spread. One row per feature and section at most."""

    def section(table: DataFrame, name: Column | str, value: str, limit: int | None) -> DataFrame:
        named = table.select(F.lit(name).alias("section") if isinstance(name, str) else name.alias("section"), "feature", F.col(value).alias("value"))
        size = F.col("value") if limit is None else F.abs("value")
        order = Window.partitionBy("section").orderBy(F.desc_nulls_last(size), "feature")
        placed = named.withColumn("place", F.row_number().over(order))
        return (placed if limit is None else placed.where(F.col("value").isNotNull() & (F.col("place") <= limit))).select("section", "place", "feature", "value")

    out = section(classes, F.col("recommendation"), "score", None)
    out = out.unionByName(section(classes, "top_rank_ic", "rank_ic_mean", top)).unionByName(section(classes, "top_spread", "long_short_mean_return", top))
    return out if held is None else out.unionByName(section(held, "top_holdout_spread", "long_short_mean_return", top))


def run_reports(
    df: DataFrame,
    market: DataFrame,
    benchmark: str,
    output: str,
    features: Sequence[str] | None = None,
    settings: ReportSettings = ReportSettings(),
    stages: Sequence[str] = STAGES,
    csv: bool = False,
) -> dict[str, str]:
    """Compute the chosen stages and write one table per report; returns their paths.

    Without a training window the recommendation reads back the reports written before it.
    """
    unknown = sorted(set(stages) - set(STAGES))
    if unknown:
        raise ValueError(f"unknown stages {unknown}")
    label, q, cs = settings.label, settings.quantiles, settings.min_cross_section
    if label not in df.columns:
        raise ValueError(f"label column not found: {label}")
    features = list(features) if features else factors.lagged_columns(df)
    if not features:
        raise ValueError("the table has no published features")
    train, judge = windows(df, settings.train_end, settings.eval_start)
    paths: dict[str, str] = {}

    def emit(name: str, table: DataFrame) -> None:
        paths[name] = f"{output}/{name}"
        write_report(table, paths[name], csv)

    known: dict[str, DataFrame] = {}

    def keep(part: str, table: DataFrame) -> DataFrame:
        """Store a report that the recommendation needs, if that is asked for and looks at the same rows."""
        if "recommendation" in stages and settings.train_end is None:
            table = known[part] = stage(table, f"report-{part}")
        return table

    daily = None
    if {"ic", "regime-ic"} & set(stages):
        daily = stage(factors.daily_ic(df, features, label, cs), "daily-ic")
    regime = regimes.label_regimes(regimes.regime_source(market, benchmark))
    if "ic" in stages:
        emit("factor_daily_ic", daily)
        emit("factor_ic_rankic", factors.ordered_ic(keep("ic", factors.ic_summary(daily, features))))
    if "quality" in stages:
        emit("feature_quality", keep("quality", factors.quality(df, features)).orderBy("missing_ratio", "feature"))
    if "correlation" in stages:
        pairs = keep("pairs", factors.correlation_pairs(df, features, top_n=None))
        ordered = pairs.orderBy(F.desc(F.abs("spearman_corr")), "feature_left", "feature_right")
        emit("feature_correlation_top", ordered.limit(100))  # the printed table
    if "quantile" in stages:
        emit("factor_quantile_long_short", factors.ordered_spread(keep("spread", factors.quantile_spread(df, features, label, q, cs))))
    if "extended-quantile" in stages:
        emit("factor_quantile_detail", factors.quantile_detail(df, features, label, q, cs))
        emit("factor_yearly_quantile_long_short", factors.yearly_quantile_spread(df, features, label, q, cs))
        emit("factor_regime_quantile_long_short", regimes.regime_quantile_spread(df, regime, features, label, q, cs))
    if "neutralized" in stages:
        emit("factor_neutralized_ic", factors.ordered_ic(factors.neutral_ic_summary(df, features, label, cs)))
    if "regime-ic" in stages:
        emit("factor_regime_ic", regimes.regime_ic_summary(daily, regime, features))
    if "recommendation" in stages:
        classes = stage(recommendation(train, features, label, q, cs, settings.max_corr, known), "classes")
        emit("feature_recommendations", classes.orderBy(F.desc("score"), "feature"))
        held = holdout_spread(judge, classes, features, label, q, cs)
        emit("factor_holdout_quantile_long_short", factors.ordered_spread(held))
        emit("class_summary", class_summary(classes, held).orderBy("section", "place"))
        emit("recommendation_counts", classes.groupBy("recommendation").agg(F.count(F.lit(1)).alias("features")))
    emit("summary", query_summary(df))
    chosen = {**vars(settings), "benchmark": benchmark, "features": ",".join(features), "stages": ",".join(stages)}
    rows = [(k, None if v is None else str(v)) for k, v in chosen.items()]
    emit("parameters", df.sparkSession.createDataFrame(rows, "parameter string, value string").coalesce(1))
    return paths
