"""Sinks for derived tables: state partitions, membership pool, reports, query results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def replace_dates(state: DataFrame, path: str) -> None:
    """Write state rows, replacing exactly the dates they hold.

    Rows are balanced by date: a large date is split over as many tasks as its bytes ask for, small ones share a task.
    """
    spread = state.hint("rebalance", "trade_date")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path)


def read_dates(spark: SparkSession, path: str, start: str, end: str, columns: list[str] | None = None) -> DataFrame:
    """A pruned read of dated partitions; the date comes back as text."""
    table = spark.read.parquet(path)
    rows = table.withColumn("trade_date", F.col("trade_date").cast("string")) if dict(table.dtypes)["trade_date"] != "string" else table
    rows = rows.where(F.col("trade_date").between(start, end))
    return rows.select(*columns) if columns else rows


def partition_dates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("trade_date").cast("string").alias("trade_date")).distinct()


def state_files(spark: SparkSession, path: str) -> DataFrame:
    """(trade_date, state_version, modified_time) of the stored state."""
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("trade_date").cast("string").alias("trade_date"), "state_version").agg(
        F.max("_metadata.file_modification_time").alias("modified_time")
    )


def write_pool(intervals: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuses to replace an existing pool unless told to."""
    intervals.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_report(table: DataFrame, path: str, csv: bool = False) -> None:
    """A report as parquet, or as CSV with a header."""
    if csv:
        table.write.mode("overwrite").option("header", True).csv(path)
    else:
        table.write.mode("overwrite").parquet(path)
