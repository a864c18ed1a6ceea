"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: half window limits in days.
HALF_DAYS_MAX = 183


def parse_event_time(text: Column) -> Column:
    """ISO date or date-time, with Z or an offset, else the first ten characters as a date, else NULL.

    A time without an offset is UTC (the session zone).
    """
    t = F.trim(text)
    dated = t.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.when(dated, F.coalesce(t.try_cast("timestamp"), F.substring(t, 1, 10).try_cast("timestamp")))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def clamp_half_days(days: Column) -> Column:
    rounded = F.floor(days + 0.5)
    return F.coalesce(F.least(F.lit(HALF_DAYS_MAX), F.greatest(F.lit(0), F.when(~F.isnan(days), rounded))), F.lit(0)).cast("int")


def window_range(center: Column, half_days: Column, today: Column) -> tuple[Column, Column]:
    """Inclusive display range, its end held at today."""
    return F.date_sub(center, half_days), F.least(F.date_add(center, half_days), today)


def window_mean_dates(center: Column, half_days: Column, today: Column) -> tuple[Column, Column]:
    """The same range with an exclusive end."""
    start, end = window_range(center, half_days, today)
    return start, F.date_add(end, 1)


def range_to_window(start: Column, end: Column) -> tuple[Column, Column]:
    """Centre and half width of an inclusive range."""
    span = F.greatest(F.lit(0), F.datediff(end, start))
    return F.date_add(start, F.floor(span / 2 + 0.5).cast("int")), F.ceil(span / 2).cast("int")


def is_closed(end: Column, today: Column | None = None) -> Column:
    """True when a range no longer reaches the present: its result is final."""
    return end < (F.current_date() if today is None else today)
