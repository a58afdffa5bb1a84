"""Clock helpers. Every report takes an explicit `as_of` and compares raw timestamps,
so the predicates reach the Parquet scan."""

from __future__ import annotations

import calendar
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

NIGHT_ENDS, NIGHT_STARTS = 6, 22


def at(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def since(ts: str | Column, start: datetime, end: datetime | None = None) -> Column:
    """`start <= ts` and, with `end`, `ts < end`."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    inside = ts >= at(start)
    return inside if end is None else inside & (ts < at(end))


def month_start(moment: datetime) -> datetime:
    return datetime(moment.year, moment.month, 1)


def last_month_start(moment: datetime) -> datetime:
    return month_start(month_start(moment) - timedelta(days=1))


def days_in_month(moment: datetime) -> int:
    return calendar.monthrange(moment.year, moment.month)[1]


def micros(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def month_key(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def is_night(hour: Column) -> Column:
    return ((hour < NIGHT_ENDS) | (hour >= NIGHT_STARTS)).cast("int")


def calendar_columns(ts: str) -> dict[str, Column]:
    """Hour, Monday-first weekday, weekend and night flags of a timestamp column."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    return {
        "hour_of_day": hour,
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "is_night_transaction": is_night(hour),
    }
