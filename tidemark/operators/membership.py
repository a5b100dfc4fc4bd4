"""Slowly-changing membership: snapshots to intervals, interval checks and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalars import as_date, date_text
from tidemark.operators.asof import asof_join
from tidemark.operators.panel import latest

# Fixed value: the end of an interval that is still open.
OPEN_END = "99991231"

POOL_COLUMNS = [
    "ts_code", "index_code", "effective_from", "effective_to", "index_weight", "source_trade_date", "name",
    "industry", "market", "list_date", "pool_version", "is_active", "created_at",
]


def normalize_snapshots(raw: DataFrame, index_code: str, recency: list[str] | None = None) -> DataFrame:
    """One index's membership rows, typed, without null keys, the most recent copy of each key kept."""
    missing = sorted({"index_code", "con_code", "trade_date", "weight"} - set(raw.columns))
    if missing:
        raise ValueError(f"membership rows lack columns {missing}")
    recency = recency or []
    rows = (
        raw.where(F.col("index_code") == index_code)
        .select(
            F.col("index_code").cast("string").alias("index_code"),
            F.col("con_code").cast("string").alias("ts_code"),
            date_text("trade_date").alias("trade_date"),
            F.col("weight").try_cast("double").alias("index_weight"),
            *recency,
        )
        .dropna(subset=["ts_code", "trade_date"])
    )
    kept = latest(rows, ["index_code", "ts_code", "trade_date"], [*recency, "index_weight"])
    return kept.select("index_code", "ts_code", "trade_date", "index_weight")


def build_intervals(snapshots: DataFrame, version: str, close_at: str = "previous_snapshot") -> DataFrame:
    """Membership intervals: consecutive snapshots holding an entity form one interval.

    An interval ends at the last snapshot that held the entity, or the day before the next snapshot with
    ``close_at='day_before_change'``; it stays open when the entity is in the final snapshot.
    """
    if close_at not in ("previous_snapshot", "day_before_change"):
        raise ValueError(f"unknown close_at: {close_at}")
    rows = snapshots.where(F.col("trade_date").isNotNull())
    # one row per snapshot day: at most the calendar, so one task and a broadcast are fine
    by_day = Window.orderBy("trade_date")
    days = (
        rows.select("trade_date")
        .distinct()
        .withColumn("place", F.row_number().over(by_day))
        .withColumn("next_day", F.lead("trade_date").over(by_day))
    )
    per_key = Window.partitionBy("index_code", "ts_code").orderBy("trade_date")
    islands = rows.join(F.broadcast(days), "trade_date").withColumn(
        "island", F.col("place") - F.row_number().over(per_key)
    )
    spans = islands.groupBy("index_code", "ts_code", "island").agg(
        F.min("trade_date").alias("effective_from"),
        F.max("trade_date").alias("source_trade_date"),
        F.max_by("index_weight", "trade_date").alias("index_weight"),
        F.max_by("next_day", "trade_date").alias("next_day"),
    )
    if close_at == "day_before_change":
        closed_on = F.date_format(F.date_sub(as_date("next_day"), 1), "yyyyMMdd")
    else:
        closed_on = F.col("source_trade_date")
    active = F.col("next_day").isNull()
    return spans.select(
        "ts_code",
        "index_code",
        "effective_from",
        F.when(active, F.lit(OPEN_END)).otherwise(closed_on).alias("effective_to"),
        "index_weight",
        "source_trade_date",
        F.lit(version).alias("pool_version"),
        active.alias("is_active"),
        F.current_timestamp().alias("created_at"),
    )


def enrich_intervals(intervals: DataFrame, basic: DataFrame, recency: list[str] | None = None) -> DataFrame:
    """Add name, industry, market and list date."""
    keep = ["name", "industry", "market", "list_date"]
    missing = [c for c in ["ts_code", *keep] if c not in basic.columns]
    if missing:
        raise ValueError(f"basic lacks columns {missing}")
    dim = basic.select("ts_code", *keep, *(recency or []))
    dim = latest(dim, ["ts_code"], [*(recency or []), *keep]).withColumn("list_date", date_text("list_date"))
    return intervals.join(dim.select("ts_code", *keep), "ts_code", "left").select(*POOL_COLUMNS)


def interval_violations(intervals: DataFrame) -> DataFrame:
    """Rows that start after they end, or start on or before the end of the interval before them."""
    per_key = Window.partitionBy("index_code", "ts_code").orderBy("effective_from", "effective_to")
    before = F.lag("effective_to").over(per_key)
    return (
        intervals.select("index_code", "ts_code", "effective_from", "effective_to")
        .withColumn("previous_to", before)
        .withColumn(
            "violation",
            F.when(F.col("effective_from") > F.col("effective_to"), "starts_after_end").when(
                F.col("effective_from") <= F.col("previous_to"), "overlap"
            ),
        )
        .where(F.col("violation").isNotNull())
    )


def interval_metrics(intervals: DataFrame) -> DataFrame:
    return intervals.agg(
        F.count(F.lit(1)).alias("pool_intervals"),
        F.count_if("is_active").alias("pool_active_intervals"),
        F.count_if(~F.col("is_active")).alias("pool_closed_intervals"),
        F.count_distinct("ts_code").alias("pool_unique_stocks"),
    )


def intervals_touching(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals that overlap [start, end]."""
    missing = sorted({"ts_code", "effective_from", "effective_to"} - set(intervals.columns))
    if missing:
        raise ValueError(f"pool lacks columns {missing}")
    return intervals.where((F.col("effective_from") <= end) & (F.col("effective_to") >= start)).select(
        "ts_code", "effective_from", "effective_to"
    )


def members_only(panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """Panel rows whose date lies in an interval of their entity.

    A semi join on the entity with the range as residual: rows never fan out, so nothing needs dropping.
    """
    spans = intervals.select(
        F.col("ts_code").alias("_member"), F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to")
    )
    inside = (F.col("ts_code") == F.col("_member")) & F.col("trade_date").between(F.col("_from"), F.col("_to"))
    return panel.join(spans, inside, "left_semi")


def membership_on(days: DataFrame, snapshots: DataFrame, max_age_days: int | None = None) -> DataFrame:
    """(trade_date, index_code, ts_code, index_weight, known_on): the members of the last snapshot on or before each trading day.

    ``days`` has (index_code, trade_date). A day without a snapshot at most ``max_age_days`` calendar days back has no members. An entity that
    a later snapshot no longer holds is gone from that snapshot's day on. Snapshots are normalised rows, one per (index, entity, day).
    """
    listed = snapshots.select("index_code", "trade_date").distinct()
    asked = days.select("index_code", "trade_date").distinct()
    dated = asof_join(asked, listed, ["index_code"], [], max_age_days=max_age_days).where(F.col("known_on").isNotNull())
    members = snapshots.select("index_code", "ts_code", F.col("trade_date").alias("known_on"), "index_weight")
    return dated.join(members, ["index_code", "known_on"]).select("trade_date", "index_code", "ts_code", "index_weight", "known_on")


def membership_files(registry: DataFrame, index_code: str) -> DataFrame:
    """Registered membership files whose name or path mentions the index."""
    return registry.where(
        (F.col("dataset") == "index_weight")
        & (F.col("status") == "ingested")
        & (F.col("filename").contains(index_code) | F.col("raw_path").contains(index_code))
    )


def pending_membership_files(registry: DataFrame, processed: DataFrame, index_code: str) -> DataFrame:
    """Membership files not processed yet, or processed with another content; empty = nothing to rebuild."""
    seen = latest(
        processed.where(F.col("index_code") == index_code).select("source_path", "md5", "processed_at"),
        ["source_path"],
        ["processed_at", "md5"],
    ).select("source_path", F.col("md5").alias("seen_md5"))
    current = membership_files(registry, index_code)
    return current.join(seen, "source_path", "left").where(
        F.col("seen_md5").isNull() | (F.col("seen_md5") != F.col("md5"))
    ).drop("seen_md5")
