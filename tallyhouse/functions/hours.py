"""Hour arithmetic on shifts, free of any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the hour label is text like 2024-05-07 09:00:00.
LABEL_TAIL = ":00:00"
HOUR_LENGTH = len("2024-05-07 09")


def one_hour() -> Column:
    return F.expr("INTERVAL '1' HOUR")


def hour_label(ts: Column) -> Column:
    """The hour as text. Formatting functions would go through the session zone."""
    return F.concat(F.substring(ts.cast("string"), 1, HOUR_LENGTH), F.lit(LABEL_TAIL))


def hour_floor(ts: Column) -> Column:
    past = F.make_dt_interval(mins=F.minute(ts), secs=F.extract(F.lit("SECOND"), ts))
    return ts - past


def elapsed_hours(start: Column, end: Column) -> Column:
    """Whole hours between two moments; the part hour is cut off."""
    return (end - start).cast("interval hour").cast("bigint")


def counted_hours(start: Column, end: Column) -> Column:
    """Elapsed hours, but a shift always counts for at least one.

    ``greatest`` skips NULLs, so a shift without an end is excluded by hand.
    """
    whole = elapsed_hours(start, end)
    return F.when(whole.isNotNull(), F.greatest(F.lit(1).cast("bigint"), whole))


def hour_slots(start: Column, end: Column) -> Column:
    """One moment per counted hour, an hour apart, from ``start`` on.

    Their number equals ``counted_hours``: a shift shorter than an hour still
    has the slot it starts in, and a trailing part hour has none.
    """
    last = F.when(end.isNotNull(), F.greatest(start, end - one_hour()))
    return F.sequence(start, last, one_hour())
