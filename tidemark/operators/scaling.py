"""Standardisation: within each date's cross-section, or by a scaler fitted on training rows and kept as a table.

Medians and median absolute deviations are exact; both come from the ranking engine's quantiles, the second over the
deviations from the first, so neither a date nor a whole training set is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import clip, finite, sdiv
from tidemark.operators.factors import long_rows
from tidemark.operators.features import KEYS
from tidemark.operators.ranking import group_quantiles
from tidemark.session import stage

ROBUST, STANDARD = "robust", "standard"


def _spread_sides(long: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    """(keys, center, spread, n) of non-null ``x``: median and median absolute deviation, or mean and sample deviation."""
    keys = list(keys)
    known = long.where(F.col("x").isNotNull())
    counts = known.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.when(F.min("x") == F.max("x"), 0.0).otherwise(F.stddev_samp("x")).alias("deviation"))
    if method == STANDARD:
        return counts.select(*keys, F.col("mean").alias("center"), F.col("deviation").alias("spread"), "n")
    if method != ROBUST:
        raise ValueError(f"unknown method: {method}")
    ids = [k for k in KEYS if k not in keys]
    rows = known.select(*keys, *ids, "x")
    centers = stage(group_quantiles(rows, keys, "x", {"center": 0.5}, ids=ids), "centers")
    apart = rows.join(centers, keys).withColumn("x", F.abs(F.col("x") - F.col("center")))
    spreads = group_quantiles(apart.select(*rows.columns), keys, "x", {"spread": 0.5}, ids=ids)
    return centers.join(spreads, keys).join(counts.select(*keys, "n"), keys).select(*keys, "center", "spread", "n")


def _scaled(x: Column, center: Column, spread: Column, limit: float | None) -> Column:
    """Null where the spread is zero or unknown."""
    z = sdiv(x - center, spread)
    return z if limit is None else clip(z, F.lit(-limit), F.lit(limit))


def cross_section_z(df: DataFrame, features: Sequence[str], method: str = ROBUST, limit: float | None = None) -> DataFrame:
    """(date, entity, feature, z): each value against its date's median and median absolute deviation (or mean and deviation)."""
    # read several times: the wide values are stored, not the long rows
    long = long_rows(stage(df.select(*KEYS, *features), "scaling-values"), features, None)
    sides = stage(_spread_sides(long, ["trade_date", "feature"], method), "cross-section-sides")
    joined = long.join(sides, ["trade_date", "feature"], "left")
    return joined.select(*KEYS, "feature", _scaled(F.col("x"), F.col("center"), F.col("spread"), limit).alias("z"))


def fit_scaler(train: DataFrame, features: Sequence[str], method: str = ROBUST) -> DataFrame:
    """(feature, method, center, spread, n): to be kept beside the model; a feature without a value has nulls and n = 0."""
    values = train.select(*KEYS, *features)
    sides = _spread_sides(long_rows(stage(values, "scaling-values") if method == ROBUST else values, features, None), ["feature"], method)
    names = train.sparkSession.createDataFrame([(f,) for f in features], "feature string")  # the configured features
    return names.join(sides, "feature", "left").select(
        "feature", F.lit(method).alias("method"), "center", "spread", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, limit: float | None = None) -> DataFrame:
    """``df`` with every feature of the scaler standardised by it; other columns stay. The scaler has one row per feature."""
    fitted = {r["feature"]: r for r in scaler.collect()}
    missing = sorted(fitted.keys() - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks columns {missing}")
    value = lambda v: F.lit(v).cast("double")
    return df.withColumns({f: _scaled(finite(f), value(r["center"]), value(r["spread"]), limit) for f, r in fitted.items()})
