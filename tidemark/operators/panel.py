"""Row-level table helpers: keep-last, keyed left joins, value sanitising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest(df: DataFrame, keys: Sequence[str], recency: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one with the greatest ``recency``.

    An aggregation, not a window: copies of a hot key are merged before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*recency)
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return kept.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join bringing only ``columns`` of the right side."""
    return left.join(right.select(*keys, *columns), list(keys), "left")
