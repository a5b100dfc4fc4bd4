"""Date coverage of a derived table against its source, and versioned audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.panel import latest


def missing_dates(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select("trade_date").distinct().join(actual.select("trade_date").distinct(), "trade_date", "left_anti")


def extra_dates(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return missing_dates(actual, expected)


def covered_dates(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select("trade_date").intersect(actual.select("trade_date"))


def edge_dates(dates: DataFrame, k: int = 3) -> DataFrame:
    """The first and last ``k`` dates; one row per day, so the windows are short."""
    up, down = Window.orderBy("trade_date"), Window.orderBy(F.desc("trade_date"))
    placed = dates.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    return placed.where((F.col("_up") <= k) | (F.col("_down") <= k)).select("trade_date")


def coverage_report(expected: DataFrame, state: DataFrame, version: str, sample_edges: int | None = None) -> DataFrame:
    """Expected, covered, missing and extra dates, broken rows on all covered dates (with ``sample_edges`` only on
    the first and last so many), and PASS or FAIL."""
    from tidemark.operators.state import state_checks

    own = state.where(F.col("state_version") == version)
    covered = covered_dates(expected, own)
    looked_at = covered if sample_edges is None else edge_dates(covered, sample_edges)
    checked = own.join(F.broadcast(looked_at), "trade_date", "left_semi")  # one row per day at most
    wanted_checks = ["duplicate_key", "null_tradable", "tradable_without_valid_price", "tradable_without_valid_volume"]

    def days(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("part"), F.lit(1).cast("long").alias("n"))

    broken = state_checks(checked).where(F.col("check_name").isin(wanted_checks))
    parts = (
        days(expected.select("trade_date").distinct(), "expected")
        .unionByName(days(covered, "covered"))
        .unionByName(days(missing_dates(expected, own), "missing"))
        .unionByName(days(extra_dates(expected, own), "extra"))
        .unionByName(broken.select(F.lit("broken").alias("part"), F.col("broken_rows").alias("n")))
    )

    def total(part: str):
        return F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0))

    row = parts.agg(
        total("expected").alias("expected_trade_dates"),
        total("covered").alias("covered_trade_dates"),
        total("missing").alias("missing_trade_dates"),
        total("extra").alias("extra_trade_dates"),
        total("broken").alias("broken_rows"),
    )
    passed = (F.col("missing_trade_dates") == 0) & (F.col("broken_rows") == 0)
    return row.withColumn("coverage_check", F.when(passed, "PASS").otherwise("FAIL"))


def audit_rows(metrics: DataFrame, version: str, stage: str) -> DataFrame:
    """A one-row metrics table as (data_version, stage, metric, value, created_at) rows."""
    names = metrics.columns
    as_text = metrics.select(*[F.col(c).cast("string").alias(c) for c in names])
    return as_text.unpivot([], names, "metric", "value").select(
        F.lit(version).alias("data_version"), F.lit(stage).alias("stage"), "metric", "value", F.current_timestamp().alias("created_at")
    )


def audit_view(log: DataFrame) -> DataFrame:
    """The latest value of every metric."""
    return latest(log, ["data_version", "stage", "metric"], ["created_at", "value"])
