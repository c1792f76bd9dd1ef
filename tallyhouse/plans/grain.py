"""One report that picks its own grain from the length of the range."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Day, as_day, day_range
from tallyhouse.functions.hours import hour_label
from tallyhouse.operators.items import venue_name_of
from tallyhouse.operators.shifts import hourly_cost, roster_shifts, shifts_on, timesheet_shifts

MEASURES = ("sales", "timesheet_wages", "roster_wages")


def pick_grain(start: Day, end: Day) -> str:
    """``hour`` for a day, ``day`` up to a month, ``total`` beyond."""
    first, last = as_day(start), as_day(end)
    if first == last:
        return "hour"
    return "day" if last < _a_month_after(first) else "total"


def _a_month_after(day: date) -> date:
    year, month = (day.year + 1, 1) if day.month == 12 else (day.year, day.month + 1)
    while True:
        try:
            return date(year, month, day.day)
        except ValueError:
            day = day.replace(day=day.day - 1)


def auto_grain_report(
    items: DataFrame,
    timesheets: DataFrame,
    rosters: DataFrame,
    venue_id: int,
    start: Day,
    end: Day,
    venues: DataFrame | None = None,
) -> DataFrame:
    """Sales, worked and planned wages of a venue at the grain of the range.

    The feeds are stacked and summed once by period, so merging them takes one
    small shuffle whatever the grain. By hour, sales and wages alike are those of
    the day.
    """
    grain = pick_grain(start, end)
    span = f"{as_day(start)}..{as_day(end)}"
    name = venue_name_of(items if venues is None else venues, venue_id).scalar()
    here = F.col("location_name") == name
    sold = items.where(
        (F.col("venue_id") == venue_id)
        & F.col("sale_date").between(F.lit(as_day(start)), F.lit(as_day(end)))
        & day_range(F.col("transaction_date"), start, end)
    )
    if grain == "hour":
        parts = {
            "sales": sold.select(hour_label(F.col("transaction_date")).alias("period"), "total_inc"),
            "timesheet_wages": hourly_cost(
                shifts_on(timesheet_shifts(timesheets.where(here)), start), clip=start
            ),
            "roster_wages": hourly_cost(
                shifts_on(roster_shifts(rosters.where(here)), start), clip=start
            ),
        }
    else:
        worked = timesheets.where(here & day_range(F.col("timesheet_date"), start, end))
        planned = rosters.where(here & day_range(F.col("roster_start_time"), start, end))

        def by_period(frame: DataFrame, ts: str, amount: str) -> DataFrame:
            period = F.to_date(ts).cast("string") if grain == "day" else F.lit(span)
            return frame.select(period.alias("period"), amount)

        parts = {
            "sales": by_period(sold, "transaction_date", "total_inc"),
            "timesheet_wages": by_period(worked, "timesheet_date", "timesheet_cost"),
            "roster_wages": by_period(planned, "roster_start_time", "roster_cost"),
        }
    stacked = _stack(parts)
    sums = [
        F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("amount"))), F.lit(0)).alias(m)
        for m in MEASURES
    ]
    if grain == "total":
        # A global aggregate has its row even when no feed has any.
        summed = stacked.agg(*sums).select(F.lit(span).alias("period"), *MEASURES)
    else:
        summed = stacked.groupBy("period").agg(*sums)
    return summed.select(F.lit(grain).alias("grain"), "period", *MEASURES).orderBy("period")


def _stack(parts: dict[str, DataFrame]) -> DataFrame:
    stacked = None
    for measure, frame in parts.items():
        period, amount = frame.columns
        part = frame.select(
            F.col(period).alias("period"),
            F.lit(measure).alias("measure"),
            F.col(amount).alias("amount"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked
