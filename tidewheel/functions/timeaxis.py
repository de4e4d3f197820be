"""Calendar columns of monthly series. All take and return columns; nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASONS = ("DJF", "MAM", "JJA", "SON")
#: The mean day of the year of each month of a common year.
MID_MONTH_DAYS = (16.0, 45.5, 75.0, 105.5, 136.0, 166.5, 197.0, 228.0, 258.5, 289.0, 319.5, 350.0)


def season(month: Column) -> Column:
    """December to February are DJF, and so on."""
    return F.get(F.array(*[F.lit(s) for s in SEASONS]), ((month % 12) / 3).cast("int"))


def season_year(year: Column, month: Column) -> Column:
    """December counts to the next year's DJF."""
    return year + F.when(month == 12, 1).otherwise(0)


def quarter_label(ts: Column) -> Column:
    """First day of the quarter that starts in December, March, June or September."""
    return F.add_months(F.trunc(F.add_months(ts, 1), "quarter"), -1)


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_end(year: Column, month: Column) -> Column:
    return F.last_day(month_start(year, month))


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def from_counter(counter: Column, first_year: int = 1920) -> tuple[Column, Column]:
    """(year, month) of a counter of months whose 0 is January of first_year."""
    return (F.lit(first_year) + F.floor(counter / 12)).cast("int"), (F.pmod(counter, F.lit(12)) + 1).cast("int")


def from_decimal_year(time: Column) -> tuple[Column, Column]:
    """(year, month) of a decimal year that lies within its month."""
    year = F.floor(time)
    return year.cast("int"), F.ceil((time - year) * 12).cast("int")


def previous_day(ts: Column) -> Column:
    """Model output stamped at the end of its period, moved into it."""
    return F.date_sub(ts, 1)


def month_ends(first: Column, months: Column) -> Column:
    """The last days of so many months from that of first on."""
    return F.transform(F.sequence(F.lit(0), months - 1), lambda k: F.last_day(F.add_months(F.trunc(first, "month"), k)))


def within(ts: Column, low: str, high: str) -> Column:
    """low <= ts <= high, both inclusive; a bound may be a year or a year and month, meaning all of it."""
    start = {4: f"{low}-01-01", 7: f"{low}-01"}.get(len(low), low)
    end = F.last_day(F.lit({4: f"{high}-12-01", 7: f"{high}-01"}[len(high)]).cast("date")) if len(high) < 10 else F.lit(high).cast("date")
    return ts.cast("date").between(F.lit(start).cast("date"), end)


def rounded(value: Column, digits: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(value, digits)
