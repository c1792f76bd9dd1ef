"""Stored sums by hour, day and month, and totals of any range from the fewest of them.

Every feed is summed once by venue and hour; days are summed from hours and months
from days. A range is covered by whole months, then by the days and hours left at
both ends; what is less than an hour there is summed from the feeds themselves, of
which only the days of these edges are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import as_moment
from tallyhouse.functions.hours import hour_floor
from tallyhouse.sources.tables import write_table

MEASURES = ("sales", "timesheet_wages", "roster_wages")
LEVELS = ("hour", "day", "month")
SUMS = "venue string, measure string, period timestamp_ntz, amount decimal(38,2), level string, year int"
EDGE = "edge"  # a part of an hour


class Feeds(NamedTuple):
    """The flat item table and the two shift feeds."""

    items: DataFrame
    timesheets: DataFrame
    rosters: DataFrame


class Range(NamedTuple):
    """A venue's time from ``start`` up to, but without, ``stop``."""

    range_id: int
    venue: str
    start: datetime
    stop: datetime


def amounts(feeds: Feeds, edges: Iterable[tuple[datetime, datetime]] | None = None) -> DataFrame:
    """``venue``, ``measure``, ``at`` and ``amount`` of all feeds, or of what lies in some stretches of time.

    The days of the stretches reach the scan of the item table.
    """
    items = feeds.items
    if edges is not None:
        days = sorted({day for a, z in edges for day in (a.date(), (z - timedelta(microseconds=1)).date())})
        items = items.where(F.col("sale_date").isin(days) if days else F.lit(False))

    def part(frame: DataFrame, measure: str, venue: str, at: str, amount: str) -> DataFrame:
        if edges is not None:
            inside = F.lit(False)
            for a, z in edges:
                inside |= (F.col(at) >= _moment(a)) & (F.col(at) < _moment(z))
            frame = frame.where(inside)
        return frame.select(F.col(venue).alias("venue"), F.lit(measure).alias("measure"), F.col(at).alias("at"), F.col(amount).cast("decimal(28,2)").alias("amount"))

    return (
        part(items, "sales", "venue_name", "transaction_date", "total_inc")
        .unionByName(part(feeds.timesheets, "timesheet_wages", "location_name", "timesheet_date", "timesheet_cost"))
        .unionByName(part(feeds.rosters, "roster_wages", "location_name", "roster_start_time", "roster_cost"))
    )


def _moment(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def _summed(rows: DataFrame, period: Column) -> DataFrame:
    return rows.groupBy("venue", "measure", period.cast("timestamp_ntz").alias("period")).agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))


def build_rollups(feeds: Feeds, path: str) -> None:
    """Write the sums of all levels to ``path``, by level and year; rows without a venue or time are in no range and in no sum."""
    spark = feeds.items.sparkSession
    rows = amounts(feeds).where("venue IS NOT NULL AND at IS NOT NULL AND amount IS NOT NULL")
    periods = (hour_floor(F.col("at")), F.date_trunc("day", "period"), F.date_trunc("month", "period"))
    for level, period in zip(LEVELS, periods, strict=True):
        sums = _summed(rows, period).select("*", F.lit(level).alias("level"), F.year("period").alias("year"))
        write_table(sums, path, ("level", "year"))
        rows = read_rollups(spark, path).where(F.col("level") == level)  # the next level is summed from this one


def read_rollups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMS).parquet(path)


def _up(at: datetime, level: str) -> datetime:
    """The first beginning of a period not before a moment."""
    low = _down(at, level)
    return low if low == at else _next(low, level)


def _down(at: datetime, level: str) -> datetime:
    at = at.replace(minute=0, second=0, microsecond=0)
    return at if level == "hour" else at.replace(hour=0) if level == "day" else at.replace(hour=0, day=1)


def _next(at: datetime, level: str) -> datetime:
    if level == "month":
        return at.replace(year=at.year + at.month // 12, month=at.month % 12 + 1)
    return at + (timedelta(days=1) if level == "day" else timedelta(hours=1))


def cover(start: datetime, stop: datetime) -> list[tuple[str, datetime, datetime]]:
    """Stretches (level, from, to) that make up a range, each of whole periods of its level, coarse ones wherever they fit."""
    if start >= stop:
        return []
    for level in reversed(LEVELS):
        first, last = _up(start, level), _down(stop, level)
        if first < last:
            return [*cover(start, first), (level, first, last), *cover(last, stop)]
    # Less than an hour, or parts of two.
    between = _up(start, "hour")
    cuts = [start, between, stop] if start < between < stop else [start, stop]
    return [(EDGE, a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def range_totals(spark: SparkSession, path: str, feeds: Feeds, ranges: Iterable[Range]) -> DataFrame:
    """``range_id`` and the sums of all measures for every range, 0 where there is nothing.

    The ranges are a list of the caller's, a few stretches each; the sums and rows
    that lie in them are found by a join on the venue.
    """
    ranges = [Range(r.range_id, r.venue, as_moment(r.start), as_moment(r.stop)) for r in ranges]
    pieces = [(r.range_id, r.venue, *piece) for r in ranges for piece in cover(r.start, r.stop)]
    schema = "range_id bigint, of_venue string, of_level string, start timestamp_ntz, stop timestamp_ntz"
    wanted = spark.createDataFrame(pieces, schema)
    asked = spark.createDataFrame([(r.range_id,) for r in ranges], "range_id bigint")
    years = sorted({y for *_, level, a, z in pieces if level != EDGE for y in range(a.year, z.year + 1)})
    stored = read_rollups(spark, path).where(F.col("year").isin(years) if years else F.lit(False))
    edges = sorted({(a, z) for *_, level, a, z in pieces if level == EDGE})
    loose = amounts(feeds, edges).select("venue", "measure", F.col("at").alias("period"), "amount", F.lit(EDGE).alias("level"))
    every = stored.select("venue", "measure", "period", "amount", "level").unionByName(loose)
    here = (F.col("venue") == F.col("of_venue")) & (F.col("level") == F.col("of_level"))
    met = every.join(wanted, here & (F.col("period") >= F.col("start")) & (F.col("period") < F.col("stop")))
    sums = met.groupBy("range_id").agg(*[F.sum(F.when(F.col("measure") == m, F.col("amount"))).alias(m) for m in MEASURES])
    return asked.join(sums, "range_id", "left").select("range_id", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in MEASURES])
