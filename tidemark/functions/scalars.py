"""Column helpers. All of them keep data null-only: no NaN and no infinity leaves this module."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text that stands for a missing date.
MISSING_DATE_TEXT = ["<NA>", "nan", "NaN", "None"]

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sdiv(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a), col(b))


def growth(a: ColumnOrName, b: ColumnOrName) -> Column:
    return sdiv(a, b) - 1


def finite(c: ColumnOrName) -> Column:
    """A double with NaN and +-infinity turned into null; text that is no number becomes null too."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def date_text(c: ColumnOrName) -> Column:
    """An eight-digit date as text: a trailing '.0' goes, tokens for 'missing' become null."""
    text = F.regexp_replace(col(c).cast("string"), r"\.0$", "")
    return F.when(~text.isin(MISSING_DATE_TEXT), text)


def as_date(c: ColumnOrName) -> Column:
    """Text yyyyMMdd to a date, null where it does not parse."""
    return F.try_to_timestamp(col(c), F.lit("yyyyMMdd")).cast("date")


def round_to_tick(value: ColumnOrName, tick: float) -> Column:
    """Round half-even to a multiple of ``tick``."""
    return F.rint(col(value) / F.lit(tick)) * F.lit(tick)


def clip(c: ColumnOrName, low: ColumnOrName | None = None, high: ColumnOrName | None = None) -> Column:
    """Clip, keeping null values null (greatest and least skip nulls); a null bound does not clip."""
    x = col(c)
    out = x
    if low is not None:
        out = F.greatest(out, col(low))
    if high is not None:
        out = F.least(out, col(high))
    return F.when(x.isNotNull(), out)


def flag(condition: Column) -> Column:
    """1/0 with null counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


GRID_OFFSET = 0.3819660112501051


def grid_sql(c: str, digits: int = 6) -> str:
    scale = 10**digits
    return f"(floor(`{c}` * {scale}D + {GRID_OFFSET}D) / {scale}D)"


def grid(c: ColumnOrName, digits: int = 6) -> Column:
    """Floor to a decimal grid, for comparing results of sums taken in different orders.

    The offset keeps ordinary values (halves, tenths, ..) away from the cell borders.
    """
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(GRID_OFFSET)) / F.lit(scale)
