"""Model-ready tables: time splits, flat rows, sequence windows, manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalars import finite
from tidemark.functions.windows import trailing_matrix
from tidemark.operators.features import KEYS
from tidemark.operators.labels import LABEL

# The default split, inclusive date ranges.
DEFAULT_SPLIT = {
    "train": ("20160104", "20221231"),
    "validation": ("20230101", "20241231"),
    "test": ("20250101", "20260525"),
}


def with_split(df: DataFrame, split: dict[str, tuple[str, str]] = DEFAULT_SPLIT) -> DataFrame:
    """Label rows by date range, a later range winning over an earlier one; other rows drop out."""
    name = F.lit(None).cast("string")
    for part, (start, end) in split.items():
        name = F.when(F.col("trade_date").between(start, end), part).otherwise(name)
    return df.withColumn("split", name).where(F.col("split").isNotNull())


def chosen_features(df: DataFrame, configured: Sequence[str]) -> list[str]:
    """The configured features the table has, in configured order."""
    present = [f for f in configured if f in df.columns]
    if not present:
        raise ValueError("no configured feature is in the table")
    return present


def flat_dataset(
    df: DataFrame, features: Sequence[str], label: str = LABEL, split: dict[str, tuple[str, str]] = DEFAULT_SPLIT
) -> DataFrame:
    names = chosen_features(df, features)
    return with_split(df.select(*KEYS, label, *names), split).dropna(subset=[label])


def sequence_dataset(
    df: DataFrame,
    features: Sequence[str],
    lookback: int,
    label: str = LABEL,
    split: dict[str, tuple[str, str]] = DEFAULT_SPLIT,
) -> DataFrame:
    """Per labelled row the last ``lookback`` labelled rows of its entity as x[step][feature]; rows with a
    shorter history or any null in the window drop out. A window may reach back across a split border."""
    names = chosen_features(df, features)
    rows = with_split(df.select(*KEYS, finite(label).alias(label), *[finite(f).alias(f) for f in names]), split)
    rows = rows.where(F.col(label).isNotNull())
    return (
        rows.withColumn("x", trailing_matrix(names, lookback))
        .where(F.col("x").isNotNull())
        .select(*KEYS, "x", F.col(label).cast("float").alias("y"), "split")
    )


def manifest(datasets: dict[str, tuple[DataFrame, int]], version: str) -> DataFrame:
    """Rows per dataset and split, with the feature count: ``datasets`` maps name to (table, features)."""
    parts = [
        df.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(version).alias("data_version"), F.lit(name).alias("dataset"), F.lit(n).alias("features"), "split", "rows"
        )
        for name, (df, n) in datasets.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
