"""Operational reports over the lake tables.

``items`` is the flat table made by ``operators.items.sale_items``; ``venue_id``
and ``location`` narrow a report to one venue, ranges include both end days.
"""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Day, Moment, as_day, as_moment, day_range, trailing_months
from tallyhouse.operators.items import venue_name_of
from tallyhouse.operators.merge import full_join_on_key
from tallyhouse.operators.shifts import hourly_cost, roster_shifts, shifts_on, timesheet_shifts

# Fixed value: the item group of beverages.
BEVERAGE_GROUP = 1


def _zero_if_none(total: Column) -> Column:
    return F.coalesce(total, F.lit(0))


def _sold_between(items: DataFrame, start: Day, end: Day) -> DataFrame:
    """``sale_date`` repeats the range so that a table partitioned by it prunes."""
    days = F.col("sale_date").between(F.lit(as_day(start)), F.lit(as_day(end)))
    return items.where(days & day_range(F.col("transaction_date"), start, end))


def beverage_sales_total(
    items: DataFrame, venue_id: int, start: Day, end: Day, group: int = BEVERAGE_GROUP
) -> DataFrame:
    return (
        _sold_between(items, start, end)
        .where((F.col("venue_id") == venue_id) & (F.col("master_group_id") == group))
        .agg(F.sum("total_inc").alias("beverage_sale_inc"))
    )


def daily_sales(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys, F.to_date("transaction_date").alias("date")).agg(
        F.sum("total_inc").alias("sales")
    )


def daily_wages(timesheets: DataFrame, *keys: str) -> DataFrame:
    return timesheets.groupBy(*keys, F.to_date("timesheet_date").alias("date")).agg(
        F.sum("timesheet_cost").alias("wages")
    )


def daily_sales_vs_wages(
    items: DataFrame,
    timesheets: DataFrame,
    venue_id: int,
    start: Day,
    end: Day,
    venues: DataFrame | None = None,
) -> DataFrame:
    """Sales and wages of one venue per day.

    The venue's name is a scalar subquery, so it reaches the timesheet scan as
    a pushed filter. ``venues`` may be a stored venue dimension, which spares
    the pass over the sales. An unknown venue has no name and hence no wages.
    """
    name = venue_name_of(items if venues is None else venues, venue_id).scalar()
    sales = daily_sales(_sold_between(items, start, end).where(F.col("venue_id") == venue_id))
    wages = daily_wages(
        timesheets.where(
            (F.col("location_name") == name) & day_range(F.col("timesheet_date"), start, end)
        )
    )
    return full_join_on_key(sales, wages, "date", ["sales", "wages"]).orderBy("date")


def hourly_roster_vs_timesheet(
    rosters: DataFrame, timesheets: DataFrame, location: str, day: Day, clip: bool = False
) -> DataFrame:
    """Planned and worked cost per hour of the shifts that touch ``day``."""
    here = F.col("location_name") == location
    window = day if clip else None
    planned = hourly_cost(shifts_on(roster_shifts(rosters.where(here)), day), clip=window)
    worked = hourly_cost(shifts_on(timesheet_shifts(timesheets.where(here)), day), clip=window)
    return full_join_on_key(
        planned.withColumnRenamed("hourly_cost", "roster_wages"),
        worked.withColumnRenamed("hourly_cost", "timesheet_wages"),
        "hour",
        ["timesheet_wages", "roster_wages"],
    ).orderBy("hour")


def total_roster_vs_timesheet(
    rosters: DataFrame, timesheets: DataFrame, location: str, start: Day, end: Day
) -> DataFrame:
    """One row of totals. Each side is a global aggregate, hence exactly a row."""
    here = F.col("location_name") == location
    worked = timesheets.where(here & day_range(F.col("timesheet_date"), start, end)).agg(
        _zero_if_none(F.sum("timesheet_cost")).alias("timesheet_wages")
    )
    planned = rosters.where(here & day_range(F.col("roster_start_time"), start, end)).agg(
        _zero_if_none(F.sum("roster_cost")).alias("roster_wages")
    )
    return worked.crossJoin(planned)


def top_products(
    items: DataFrame, as_of: Moment, months: int = 3, k: int = 10, group: int = BEVERAGE_GROUP
) -> DataFrame:
    """Best-selling products; equal quantities are ordered by name."""
    now = as_moment(as_of)
    # One day more than the longest run of months keeps the pruning range wide.
    earliest = now.date() - timedelta(days=31 * months + 1)
    return (
        items.where(F.col("sale_date").between(F.lit(earliest), F.lit(now.date())))
        .where(trailing_months(F.col("transaction_date"), as_of, months))
        .where(F.col("master_group_id") == group)
        .groupBy("product_name")
        .agg(F.sum("quantity").alias("total_quantity"))
        .orderBy(F.desc("total_quantity"), "product_name")
        .limit(k)
    )


def member_spend(sales: DataFrame, start: Day, end: Day) -> DataFrame:
    """Spend per member with the balances of the latest sale in the range.

    The items of a sale are summed inside its row, so each sale enters the
    aggregation once and without its items. Sales at one instant are told apart
    by their id, a sale without one counting as the lowest: time and id are packed
    into one number, because an order by a struct would put the rows through a
    sort instead of a hash aggregation.
    """
    sale = F.col("Sales_Details")
    zero = F.lit(0).cast("decimal(22,2)")
    spend = F.aggregate(
        sale["Items"],
        zero,
        lambda total, item: (total + F.coalesce(item["Total_Inc"], zero)).cast("decimal(22,2)"),
    )
    micros = F.unix_micros(sale["Transaction_Date"].cast("timestamp_ltz")).cast("decimal(18,0)")
    latest = micros * F.lit(Decimal(10**19)) + F.coalesce(sale["Transaction_Id"], F.lit(0))
    per_sale = (
        sales.where(day_range(sale["Transaction_Date"], start, end))
        .where(F.size(sale["Items"]) > 0)
        .select(
            sale["Member_Id"].alias("member_id"),
            sale["Member_Name"].alias("member_name"),
            spend.alias("spend"),
            sale["Member_Account_Balance"].alias("account_balance"),
            sale["Member_Points_Balance"].alias("points_balance"),
            latest.alias("latest"),
        )
    )
    return per_sale.groupBy("member_id", "member_name").agg(
        F.sum("spend").alias("spend"),
        F.count(F.lit(1)).alias("sales"),
        F.max_by("account_balance", "latest").alias("account_balance"),
        F.max_by("points_balance", "latest").alias("points_balance"),
    )
