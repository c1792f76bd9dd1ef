"""Date ranges. Every range takes its clock as an argument, so reruns agree."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Day = date | str
Moment = datetime | str


def as_day(value: Day) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value


def as_moment(value: Moment) -> datetime:
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def moment(value: Moment) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(as_moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def day_start(value: Day) -> Column:
    return moment(datetime.combine(as_day(value), datetime.min.time()))


def day_range(ts: Column, start: Day, end: Day) -> Column:
    """Both days included. Half open, so the last second of ``end`` is whole."""
    return (ts >= day_start(start)) & (ts < day_start(as_day(end) + timedelta(days=1)))


def overlaps_day(start: Column, end: Column, day: Day) -> Column:
    """The interval shares at least an instant with ``day``."""
    return (start < day_start(as_day(day) + timedelta(days=1))) & (end >= day_start(day))


def months_before(ts: Column, months: int) -> Column:
    """Shift by calendar months and keep the time of day."""
    return ts - F.make_ym_interval(F.lit(0), F.lit(months))


def trailing_months(ts: Column, as_of: Moment, months: int) -> Column:
    now = moment(as_of)
    return ts.between(months_before(now, months), now)


def last_n_days(ts: Column, as_of: Moment, days: int) -> Column:
    """``days`` calendar days ending with, and counting, the day of ``as_of``."""
    today = as_moment(as_of).date()
    return day_range(ts, today - timedelta(days=days - 1), today)
