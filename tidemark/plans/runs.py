"""Incremental runs over stored tables: build only what changed, and record what was done."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators import coverage, membership, state
from tidemark.session import stage
from tidemark.sources import ingest, tables

PROCESSED = "index_code string, source_path string, md5 string, processed_at timestamp"
BUILT = "trade_date string, state_version string, modified_time timestamp"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def update_state(
    spark: SparkSession,
    raw_root: str,
    registry: DataFrame,
    state_path: str,
    basic: DataFrame,
    days: DataFrame | None,
    rules: dict[str, Any],
    version: str,
    min_listed_days: int = 0,
) -> DataFrame:
    """Build the state of the dates that have none of this version, or older than their raw files, and replace exactly
    these. Returns the dates."""
    raw = ingest.raw_files(spark, raw_root, "daily")
    try:
        raw = raw.unionByName(ingest.raw_files(spark, raw_root, "stock_st"))
        flagged = ingest.read_raw(spark, raw_root, registry, "stock_st")
    except AnalysisException:  # no such raw table
        flagged = spark.createDataFrame([], "trade_date string, ts_code string")
    try:
        built = tables.state_files(spark, state_path)
    except AnalysisException:
        built = spark.createDataFrame([], BUILT)
    dates = stage(state.affected_dates(raw, built, version), "dates-to-build")
    if dates.isEmpty():
        return dates
    chosen = F.broadcast(dates)  # one row per day at most
    daily = ingest.read_raw(spark, raw_root, registry, "daily").join(chosen, "trade_date", "left_semi")
    rows = state.daily_state(daily, basic, flagged.join(chosen, "trade_date", "left_semi"), days, rules, version, min_listed_days)
    tables.replace_dates(stage(rows, "state-to-write"), state_path)
    return dates


def update_pool(spark: SparkSession, raw: DataFrame, registry: DataFrame, processed_path: str, pool_path: str, index_code: str, version: str) -> bool:
    """Rebuild an index's membership intervals if a registered file of it is new or has changed, and record the files."""
    processed = _stored(spark, processed_path, PROCESSED)
    pending = stage(membership.pending_membership_files(registry, processed, index_code), "pool-files")
    if pending.isEmpty():
        return False
    intervals = membership.build_intervals(membership.normalize_snapshots(raw, index_code), version)
    tables.write_pool(intervals, pool_path, overwrite=True)
    done = pending.select(F.lit(index_code).alias("index_code"), "source_path", "md5", F.current_timestamp().alias("processed_at"))
    done.write.mode("append").parquet(processed_path)
    return True


def append_audit(metrics: DataFrame, version: str, stage_name: str, path: str) -> None:
    """Add a one-row metrics table to the audit log."""
    coverage.audit_rows(metrics, version, stage_name).write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The latest value of every metric in the log."""
    return coverage.audit_view(spark.read.parquet(path))
