"""Time functions (F-15 to F-20, F-42)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def ts_us(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ or DATE, the order key of all frames."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def parse_utc(text: Column) -> Column:
    """F-15: ISO text with Z, an offset or none (then UTC) to TIMESTAMP_NTZ in UTC."""
    naive = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.to_utc_timestamp(F.try_to_timestamp(naive), F.current_timezone()).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    """F-17: fractional days."""
    return (ts_us(later) - ts_us(earlier)) / DAY_US


def date_of(year: Column, doy: Column) -> Column:
    """F-18."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def clock(hhmm: Column) -> Column:
    """F-19: HHMM integer to hours."""
    return F.floor(hhmm / 100) + F.pmod(hhmm, F.lit(100)) / 60


def at_clock(date: Column, hhmm: Column) -> Column:
    """S-11, F-19: date and HHMM integer (or text) to TIMESTAMP_NTZ; NULL if either is not valid."""
    return F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), F.lpad(hhmm.cast("string"), 4, "0")), F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz")


def local_hour(hhmm: Column, offset: float = 5.5) -> Column:
    """F-19."""
    return F.pmod(clock(hhmm) + offset, F.lit(24.0))


def minutes(hhmm: Column) -> Column:
    """F-42: HH:MM text to minutes."""
    return F.split(hhmm, ":")[0].cast("int") * 60 + F.split(hhmm, ":")[1].cast("int")


def within_clock(at: Column, begin: Column, end: Column) -> Column:
    """F-20: inclusive window, also over midnight. All in minutes."""
    return F.when(end >= begin, at.between(begin, end)).otherwise((at >= begin) | (at <= end))


def period_end(day: Column, period: str) -> Column:
    """F-16: the day after the calendar month or year of day."""
    return F.add_months(F.trunc(day, period), 12 if period == "year" else 1)
