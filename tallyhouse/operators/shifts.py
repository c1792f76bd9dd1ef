"""Shifts: worked times, overlap with a day and cost per hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Day, day_start, overlaps_day
from tallyhouse.functions.hours import counted_hours, elapsed_hours, hour_floor, hour_label, one_hour


def roster_shifts(rosters: DataFrame) -> DataFrame:
    return rosters.select(
        "location_name",
        F.col("roster_start_time").alias("shift_start"),
        F.col("roster_end_time").alias("shift_end"),
        F.col("roster_cost").alias("cost"),
    )


def timesheet_shifts(timesheets: DataFrame) -> DataFrame:
    """Clocked times where there are any, else the paid ones."""
    return timesheets.select(
        "location_name",
        F.coalesce("clocked_start_time", "pay_start_time").alias("shift_start"),
        F.coalesce("clocked_end_time", "pay_end_time").alias("shift_end"),
        F.col("timesheet_cost").alias("cost"),
    )


def shifts_on(shifts: DataFrame, day: Day) -> DataFrame:
    return shifts.where(overlaps_day(F.col("shift_start"), F.col("shift_end"), day))


def backward_shifts(shifts: DataFrame) -> DataFrame:
    """Shifts that end before they start. They count an hour, the one they start in, like any shorter than that."""
    return shifts.where(F.col("shift_end") < F.col("shift_start"))


def shift_slots(shifts: DataFrame, start: Column, end: Column, name: str = "slot") -> DataFrame:
    """A row per shift and counted hour, an hour apart from the start on.

    Weeks are unnested before the hours in them, so no array is longer than a week
    or than the weeks of a shift.
    """
    last = F.greatest(start, end - one_hour())
    weeks = shifts.select("*", last.alias("_last"), start.alias("_first"))
    weeks = weeks.select("*", F.explode(F.sequence("_first", "_last", _week())).alias("_week"))
    to = F.least(F.col("_last"), F.col("_week") + _week() - one_hour())
    return weeks.select("*", F.explode(F.sequence("_week", to, one_hour())).alias(name)).drop("_last", "_first", "_week")


# Hours whose running sums are made together.
WEEK = 168
_SUMS = ("n", "known", "share")


def _week() -> Column:
    return F.expr("INTERVAL '7' DAY")


def hourly_cost(shifts: DataFrame, keys: Sequence[str] = (), clip: Day | None = None) -> DataFrame:
    """Spread each shift's cost evenly over its counted hours and sum per hour label.

    A sweep over the hours: a shift adds its share at the hour it starts in and
    takes it back after the last one, so it costs two steps however long it is.
    Steps are summed per hour before they go anywhere, a crowded venue in every
    task first. Running sums are made in two passes: one over the sums of whole
    weeks, which says what every week begins with, and one inside each week. An
    hour in which any shift counts has a row, also at no cost; if no cost of it is
    known, that is NULL. Shares are decimals, so what was added is taken back whole.

    A shift running past midnight keeps its hours outside the requested day
    unless ``clip`` names that day. No shift is left out for its length; one without
    start or end has no hours, one that ends before it starts has its first.
    """
    blocks = (
        shifts.where(F.col("shift_start").isNotNull() & F.col("shift_end").isNotNull())
        .groupBy(
            *keys,
            elapsed_hours(_epoch(), hour_floor(F.col("shift_start"))).alias("first_hour"),
            counted_hours(F.col("shift_start"), F.col("shift_end")).alias("hours"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.count("cost").alias("known"), F.sum("cost").alias("cost"))
        .select("*", (F.coalesce("cost", F.lit(0)) / F.col("hours").cast("decimal(10,0)")).alias("share"))
    )
    up = F.struct(F.col("first_hour").alias("hour"), *_SUMS)
    down = F.struct((F.col("first_hour") + F.col("hours")).alias("hour"), *[(-F.col(c)).alias(c) for c in _SUMS])
    steps = _summed(blocks.select(*keys, F.inline(F.array(up, down))), *keys, "hour")
    week = F.floor(F.col("hour") / WEEK).alias("week")
    points = _summed(steps.unionByName(_week_starts(_summed(steps, *keys, week), keys)), *keys, week, "hour")
    inside = Window.partitionBy(*keys, "week").orderBy("hour")
    running = points.select(
        *keys,
        "hour",
        F.coalesce(F.lead("hour").over(inside), (F.col("week") + 1) * WEEK).alias("next"),
        *[F.sum(c).over(inside).alias(c) for c in _SUMS],
    ).where("n > 0")
    slots = running.select(*keys, F.explode(F.sequence("hour", F.col("next") - 1)).alias("number"), "known", "share")
    if clip is not None:
        first = elapsed_hours(_epoch(), day_start(clip))
        slots = slots.where((F.col("number") >= first) & (F.col("number") < first + 24))
    hour = _epoch() + F.make_dt_interval(hours=F.col("number").cast("int"))
    cost = F.when(F.col("known") > 0, F.round("share", 6))
    return slots.select(*keys, hour_label(hour).alias("hour"), cost.alias("hourly_cost"))


def _epoch() -> Column:
    return day_start("1970-01-01")


def _summed(steps: DataFrame, *by: str | Column) -> DataFrame:
    return steps.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _week_starts(weeks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What lasts from earlier weeks, as a step at the first hour of every week it reaches.

    Weeks without a step of their own lie between two that have some; the last
    week with a step ends what there is.
    """
    order = Window.partitionBy(*keys).orderBy("week")
    so_far = weeks.select("*", F.lead("week").over(order).alias("next"), *[F.sum(c).over(order).alias(f"all_{c}") for c in _SUMS])
    reached = F.sequence(F.col("week"), F.when(F.col("all_n") > 0, F.col("next") - 1).otherwise(F.col("week")))
    spread = so_far.select("*", F.explode(reached).alias("at"))
    own = F.col("at") == F.col("week")  # begins with what was there before its own steps
    lasting = [(F.col(f"all_{c}") - F.when(own, F.col(c)).otherwise(F.lit(0))).alias(c) for c in _SUMS]
    return spread.select(*keys, (F.col("at") * WEEK).alias("hour"), *lasting).where("n > 0")
