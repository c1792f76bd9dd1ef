"""Daily figures per venue from all four feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Day, as_day, day_range
from tallyhouse.operators.items import venue_dimension

MEASURES = ("sales", "wages", "roster_cost", "egm_turnover", "egm_wins")


def dashboard_daily(
    items: DataFrame,
    timesheets: DataFrame,
    rosters: DataFrame,
    egm: DataFrame,
    start: Day,
    end: Day,
    venues: DataFrame | None = None,
) -> DataFrame:
    """One row per venue and date on which any feed has a figure.

    Each feed is summed per venue and date on its own; the small results are
    stacked and summed again. Compared with a chain of full joins this needs a
    single exchange after the feeds' own, and no re-sorting by merged keys.
    Readings of a machine whose venue never sold anything have no name and are
    kept under NULL.
    """
    names = venue_dimension(items if venues is None else venues).withColumnsRenamed(
        {"venue_id": "named_id", "venue_name": "venue"}
    )
    sold = items.where(
        F.col("sale_date").between(F.lit(as_day(start)), F.lit(as_day(end)))
        & day_range(F.col("transaction_date"), start, end)
    )
    worked = timesheets.where(day_range(F.col("timesheet_date"), start, end))
    planned = rosters.where(day_range(F.col("roster_start_time"), start, end))
    read = egm.where(F.col("Date").between(F.lit(as_day(start)), F.lit(as_day(end))))
    machines = (
        read.groupBy("Venue_Id", "Date")
        .agg(F.sum("EGM Turnover").alias("egm_turnover"), F.sum("EGM Wins").alias("egm_wins"))
        .join(names, F.col("Venue_Id") == F.col("named_id"), "left")
        .select("venue", F.col("Date").alias("date"), "egm_turnover", "egm_wins")
    )
    feeds = [
        _per_day(sold, "venue_name", F.to_date("transaction_date"), "total_inc", "sales"),
        _per_day(worked, "location_name", F.to_date("timesheet_date"), "timesheet_cost", "wages"),
        _per_day(planned, "location_name", F.to_date("roster_start_time"), "roster_cost", "roster_cost"),
        machines,
    ]
    stacked = feeds[0]
    for feed in feeds[1:]:
        stacked = stacked.unionByName(feed, allowMissingColumns=True)
    return stacked.groupBy("venue", "date").agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]
    )


def _per_day(frame: DataFrame, venue: str, day: Column, amount: str, measure: str) -> DataFrame:
    return frame.groupBy(F.col(venue).alias("venue"), day.alias("date")).agg(
        F.sum(amount).alias(measure)
    )
