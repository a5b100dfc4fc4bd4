"""Trading calendar: open-day numbers and listed trading days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalars import as_date, date_text


def open_days(calendar: DataFrame) -> DataFrame:
    """Open days numbered from 0.

    A calendar has one row per day, so the unpartitioned window is short.
    """
    days = (
        calendar.where(F.coalesce(F.col("is_open").try_cast("double"), F.lit(0.0)).cast("int") == 1)
        .select(date_text("cal_date").alias("cal_date"))
        .dropna()
        .distinct()
    )
    return days.withColumn("trade_index", F.row_number().over(Window.orderBy("cal_date")) - 1)


def next_open_index(dates: DataFrame, column: str, days: DataFrame) -> DataFrame:
    """For each distinct date: the number of open days before it, i.e. the index of the first open day on
    or after it (past the last open day: one more than the last index).

    Dates and open days are merged and counted in order; both are bounded by the calendar.
    """
    probes = dates.select(F.col(column).alias("day")).dropna().distinct().withColumn("opens", F.lit(0))
    merged = probes.unionByName(days.select(F.col("cal_date").alias("day"), F.lit(1).alias("opens")))
    # at equal days the probe (0) comes first, so an open day does not count itself
    so_far = Window.orderBy("day", "opens").rowsBetween(Window.unboundedPreceding, 0)
    counted = merged.withColumn("next_index", F.sum("opens").over(so_far))
    return counted.where(F.col("opens") == 0).select(F.col("day").alias(column), "next_index")


def with_listed_days(panel: DataFrame, days: DataFrame | None, output: str = "listed_days", entities: DataFrame | None = None) -> DataFrame:
    """Trading days since listing, the listing day counted; 0 for a null list date or a closed day.

    Without a calendar: plain days between the two dates. ``entities`` is a table that holds all list dates (one row per
    entity), so that the panel need not be read for them. List dates number at most the days of the calendar's
    span, so their numbers are broadcast and the panel stays where it is.
    """
    if days is None:
        gap = F.datediff(as_date("trade_date"), as_date("list_date"))
        return panel.withColumn(output, F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).cast("long"))
    listed = F.broadcast(next_open_index(panel if entities is None else entities, "list_date", days))
    today = F.broadcast(days.select(F.col("cal_date").alias("trade_date"), "trade_index"))  # one row per day
    joined = panel.join(today, "trade_date", "left").join(listed, "list_date", "left")
    gap = F.col("trade_index") - F.col("next_index") + 1
    return joined.withColumn(output, F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).cast("long")).drop(
        "trade_index", "next_index"
    )


def holiday_distance(days: DataFrame, longest_weekend: int = 3) -> DataFrame:
    """(cal_date, days_since_holiday, days_to_holiday) of open days: a holiday lies where two open days are more than
    ``longest_weekend`` calendar days apart.

    The first open day after a holiday is at distance 1, as is the last one before the next. Before the first holiday and after the last there
    is no distance. A calendar has one row per day, so its windows are short.
    """
    order = Window.orderBy("cal_date")
    apart = F.date_diff(as_date("cal_date"), as_date(F.lag("cal_date").over(order)))
    runs = days.select("cal_date").distinct().withColumn("_opens", F.coalesce(apart > longest_weekend, F.lit(False)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_opens").over(order)).withColumn("_last", F.max("_run").over(Window.partitionBy()))
    run = Window.partitionBy("_run")
    since = F.when(F.col("_run") > 0, F.row_number().over(run.orderBy("cal_date")))
    until = F.when(F.col("_run") < F.col("_last"), F.row_number().over(run.orderBy(F.desc("cal_date"))))
    return runs.select("cal_date", since.alias("days_since_holiday"), until.alias("days_to_holiday"))
