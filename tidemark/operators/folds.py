"""Walk-forward folds: expanding or rolling training windows, each followed by a test window.

A fold is a range of places in the trading calendar. Ranges are exploded into (fold, part, place) and joined to the calendar and then
to the rows by equality, so rows meet their folds without a range or cartesian join. A training row whose label is only known on or after the first day
of the fold's test window is purged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.windows import led

FOLD_SCHEMA = "fold int, train_from int, train_to int, test_from int, test_to int"


def fold_ranges(days: int, first_test: int, test_days: int, train_days: int | None = None, gap_days: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_from, train_to, test_from, test_to) as places 0..days-1, inclusive.

    Test windows of ``test_days`` follow each other from ``first_test`` on; a last, shorter one counts. Training ends ``gap_days`` before the
    test and starts at 0, or goes back ``train_days``. Folds without a training day are left out.
    """
    if test_days < 1 or min(first_test, gap_days) < 0 or (train_days is not None and train_days < 1):
        raise ValueError("windows need at least one day")
    ranges = []
    for start in range(first_test, days, test_days):
        end = start - 1 - gap_days
        begin = 0 if train_days is None else max(0, end - train_days + 1)
        if end >= begin:
            ranges.append((len(ranges) + 1, begin, end, start, min(days, start + test_days) - 1))
    return ranges


def fold_days(rows: DataFrame, first_test: str, test_days: int, train_days: int | None = None, gap_days: int = 0) -> DataFrame:
    """(trade_date, fold, part, test_from) for the dates of ``rows``; the first test window starts on or after ``first_test``."""
    spark = rows.sparkSession
    # at most the calendar's days: one short window, and a count for the ranges
    calendar = rows.select("trade_date").dropna().distinct().withColumn("place", F.row_number().over(Window.orderBy("trade_date")) - 1)
    total, before = calendar.agg(F.count("*"), F.count_if(F.col("trade_date") < first_test)).first()
    ranges = fold_ranges(total, before, test_days, train_days, gap_days) if before < total else []
    table = spark.createDataFrame(ranges, FOLD_SCHEMA)
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.sequence(F.col(f"{p}_from"), F.col(f"{p}_to")).alias("places")) for p in ("train", "test")])
    placed = table.select("fold", "test_from", F.inline(parts)).select("fold", "part", "test_from", F.explode("places").alias("place"))
    starts = calendar.select(F.col("trade_date").alias("test_from"), F.col("place").alias("_start"))
    return placed.withColumnRenamed("test_from", "_start").join(calendar, "place").join(starts, "_start").select("trade_date", "fold", "part", "test_from")


def walk_forward(
    rows: DataFrame, first_test: str, test_days: int, train_days: int | None = None, horizon: int = 5, gap_days: int = 0
) -> DataFrame:
    """``rows`` once for each fold and part they belong to, with ``fold`` and ``part`` ('train' or 'test').

    A label at a row is known ``horizon`` rows of its entity later; training rows whose label is not known before the fold's test window
    opens are left out. With ``horizon`` 0 nothing is purged.
    """
    known = rows.withColumn("_known_on", led("trade_date", horizon)) if horizon else rows.withColumn("_known_on", F.col("trade_date"))
    dealt = fold_days(rows, first_test, test_days, train_days, gap_days)
    joined = known.join(F.broadcast(dealt), "trade_date")  # days times folds
    usable = (F.col("part") == "test") | (F.col("_known_on") < F.col("test_from"))
    return joined.where(usable).select(*rows.columns, "fold", "part")
