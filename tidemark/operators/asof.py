"""Backward as-of joins: to each row, the last known row of its key on or before its date.

Both sides are put into time buckets. Inside a bucket one window merges the two sides of a key in date order and carries the last
known row forward. What a bucket starts with comes from the buckets before it: the last known row of each (key, bucket), carried over the key's
buckets, of which there are at most as many as the calendar has. So a key with a very long history is spread
over its buckets, and nothing is compared pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import as_date
from tidemark.operators.panel import latest
from tidemark.session import stage


def year_of(date: Column) -> Column:
    """The default bucket of a date: its year."""
    return F.substring(date, 1, 4)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    on: str = "trade_date",
    known_on: str = "known_on",
    recency: Sequence[str] = (),
    max_age_days: int | None = None,
    bucket=year_of,
) -> DataFrame:
    """``left`` with ``columns`` of the right row of equal ``keys`` and the greatest date on or before its own, and that date as ``known_on``.

    Dates are eight-digit texts. Of several right rows on one date the one of greatest ``recency``, then of greatest ``columns`` counts. A row whose
    last known date is more than ``max_age_days`` calendar days back, or who has none, gets nulls. Null keys match nothing.
    Left rows are kept as they are, repeated ones too.
    """
    keys, columns = list(keys), list(columns)
    wanted = right.select(*keys, on, *recency, *[c for c in columns if c not in recency]).dropna(subset=[*keys, on])
    known = latest(wanted, [*keys, on], [*recency, *columns]).select(*keys, F.col(on).alias("_on"), F.struct(F.col(on).alias(known_on), *columns).alias("_known"))
    known = known.withColumn("_bucket", bucket(F.col("_on")))
    rows = left.withColumns({"_on": F.col(on), "_bucket": bucket(F.col(on))})
    rows = rows.withColumn("_row", F.struct(*[F.col(c) for c in left.columns])).select(*keys, "_on", "_bucket", "_row")

    # what each (key, bucket) of either side ends with, and so what the next one starts with
    ends = known.groupBy(*keys, "_bucket").agg(F.max_by("_known", "_on").alias("_end"))
    buckets = rows.select(*keys, "_bucket").dropna().distinct().join(ends, [*keys, "_bucket"], "full")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_start")).where(F.col("_start").isNotNull())
    starts = stage(starts, "asof-starts")

    merged = rows.unionByName(known, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_bucket").orderBy("_on", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.withColumn("_last", F.last("_known", ignorenulls=True).over(so_far)).where(F.col("_row").isNotNull())
    found = carried.join(starts, [*keys, "_bucket"], "left").withColumn("_last", F.coalesce("_last", "_start"))
    own_key = F.lit(True)
    for k in keys:
        own_key &= F.col(f"_row.{k}").isNotNull()
    if max_age_days is not None:
        own_key &= F.date_diff(as_date(F.col("_on")), as_date(F.col(f"_last.{known_on}"))) <= max_age_days
    kept = F.when(own_key & F.col("_on").isNotNull(), F.col("_last"))
    return found.select("_row", kept.alias("_last")).select("_row.*", f"_last.{known_on}", *[f"_last.{c}" for c in columns])
