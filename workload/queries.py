"""Every registered query: (spark, folder of the tables) -> DataFrame.

Dates go out as text and decimals as doubles, so that both engines of the check
print them alike; everything else is the operator's own result.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions import calendar, hours, rest, text, timeparse
from tallyhouse.operators import access, context, items, nearest, shifts, snapshots, vector_index
from tallyhouse.plans import dashboard, etl, grain, reports, rollup, upkeep
from tallyhouse.plans.sql_functions import register_questions
from tallyhouse.plans.sql_surface import run_sql
from tallyhouse.plans.worked_sql import WORKED_SQL, per_hour
from tallyhouse.session import configure, fresh_dir, shuffles_removed
from tallyhouse.sources import landing, tables
from tallyhouse.streaming import ingest
from workload import standins as s

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VENUE_ID, VENUE = 2, "NATION_2"
FIRST_DAY, LAST_DAY = "1995-01-01", "2001-12-31"
MONTH = ("2000-01-01", "2000-01-31")
SHIFT_DAY = "2000-01-17"
AS_OF = "2000-03-31 12:00:00"


def portable(df: DataFrame) -> DataFrame:
    def column(field: T.StructField):
        if isinstance(field.dataType, T.DateType):
            return F.col(f"`{field.name}`").cast("string").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return F.col(f"`{field.name}`").cast("double").alias(field.name)
        return F.col(f"`{field.name}`")

    return df.select(*[column(field) for field in df.schema])


def register(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(query(configure(spark), sf_dir))

    QUERIES[query.__name__] = run
    return query


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.sale_items(s.sales(spark, sf_dir))


def _egm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.typed_egm(landing.extract_egm(s.egm(spark, sf_dir)))


def _land(df: DataFrame, feed, root: str, mode: str = "errorifexists", grouped: bool = False) -> None:
    """Put records into landing directories as JSON lines, packed: as plain text they take several times the room of all else that is written.

    ``grouped`` records come together by directory already.
    """
    records = df if grouped else tables.rebalanced(df, feed.partitions)
    with shuffles_removed(df.sparkSession):
        records.write.mode(mode).partitionBy(*feed.partitions).option("compression", "lz4").json(root)


def _land_again(spark: SparkSession, feed, root: str) -> None:
    """Put all landed records into their directories a second time, line by line as they lie there."""
    lines = spark.read.option("basePath", root).text(root)
    lines.write.mode("append").partitionBy(*feed.partitions).option("compression", "lz4").text(root)


# --- functions ---------------------------------------------------------------


def _iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as text: with and without milliseconds, empty or garbage."""
    return s.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        f"""CASE event_id % 5 WHEN 0 THEN date_format(ts, "{timeparse.WITH_MILLIS}")
            WHEN 1 THEN date_format(ts, "{timeparse.WITHOUT_MILLIS}")
            WHEN 2 THEN '' WHEN 3 THEN 'x' ELSE
            date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") || '0' END AS raw""",
    )


@register
def parse_timestamp(spark, sf_dir):
    parsed = timeparse.parse_timestamp(F.col("raw"), timeparse.WITHOUT_MILLIS)
    return _iso_times(spark, sf_dir).select(
        "event_id",
        parsed.alias("parsed"),
        timeparse.is_unparsed(F.col("raw"), parsed).alias("unparsed"),
    )


@register
def parse_timestamp_fallback(spark, sf_dir):
    formats = (timeparse.WITH_MILLIS, timeparse.WITHOUT_MILLIS)
    parsed = timeparse.parse_timestamp(F.col("raw"), *formats)
    return _iso_times(spark, sf_dir).select(
        "event_id",
        parsed.alias("parsed"),
        timeparse.is_unparsed(F.col("raw"), parsed).alias("unparsed"),
    )


@register
def regexp_extract_int(spark, sf_dir):
    """Levels out of file paths; -1 stands for a path that names none."""
    path = F.expr(
        """concat('s3://lake/sales/year=', year(o_orderdate), '/month=',
           CASE o_orderkey % 3 WHEN 0 THEN lpad(month(o_orderdate), 2, '0')
               WHEN 1 THEN cast(month(o_orderdate) AS string) ELSE 'unknown' END,
           '/day=', day(o_orderdate), '/part-0.json')"""
    )
    levels = [
        F.coalesce(timeparse.path_level(path, level), F.lit(-1)).alias(level)
        for level in ("year", "month", "day")
    ]
    return s.table(spark, sf_dir, "orders").select("o_orderkey", *levels)


@register
def struct_field_replace(spark, sf_dir):
    sale = F.struct("o_orderkey", F.date_format("o_orderdate", timeparse.WITH_MILLIS).alias("sold"))
    typed = F.col("sale").withField(
        "sold", timeparse.parse_timestamp(F.col("sale.sold"), timeparse.WITH_MILLIS)
    )
    return s.table(spark, sf_dir, "orders").select(sale.alias("sale")).select(typed.alias("sale")).select("sale.*")


@register
def cast_concat(spark, sf_dir):
    """Non-strings are cast before joining them, text before comparing with dates."""
    return (
        s.table(spark, sf_dir, "orders")
        .where(F.to_date("o_orderdate") >= F.lit("1998-07-01").cast("date"))
        .select(
            "o_orderkey",
            F.concat(
                F.lit("member "), F.col("o_custkey").cast("string"),
                F.lit(" on "), F.to_date("o_orderdate").cast("string"),
            ).alias("label"),
        )
    )


@register
def coalesce_times(spark, sf_dir):
    return shifts.timesheet_shifts(s.timesheets(spark, sf_dir))


@register
def hour_bucket(spark, sf_dir):
    label = hours.hour_label(F.col("ts")).alias("hour")
    return s.table(spark, sf_dir, "events").groupBy(label).agg(F.sum("event_id").alias("id_sum"))


@register
def elapsed_hours(spark, sf_dir):
    start, end = F.col("roster_start_time"), F.col("roster_end_time")
    return s.rosters(spark, sf_dir).select(
        "event_id",
        hours.elapsed_hours(start, end).alias("elapsed"),
        hours.counted_hours(start, end).alias("counted"),
    )


@register
def hour_slots(spark, sf_dir):
    slots = shifts.shift_slots(s.rosters(spark, sf_dir), F.col("roster_start_time"), F.col("roster_end_time"))
    return slots.select("event_id", "slot")


@register
def trailing_window(spark, sf_dir):
    recent = calendar.trailing_months(F.col("o_orderdate"), AS_OF, 3)
    return s.table(spark, sf_dir, "orders").where(recent).select(
        "o_orderkey",
        "o_orderdate",
        calendar.months_before(F.col("o_orderdate"), 3).alias("three_months_before"),
    )


@register
def last_n_days(spark, sf_dir):
    recent = calendar.last_n_days(F.col("ts"), "2024-01-15 09:30:00", 5)
    return (
        s.table(spark, sf_dir, "events")
        .where(recent)
        .groupBy(F.to_date("ts").alias("date"))
        .agg(F.sum("event_id").alias("id_sum"))
    )


# --- sources and sinks -------------------------------------------------------


@register
def scan_json_partitioned(spark, sf_dir):
    root = fresh_dir(spark, "landing-sales")
    _land(s.raw_sales(spark, sf_dir, grouped=True), etl.SALES_JOB.feed, root, grouped=True)
    raw = landing.read_landing(spark, root, etl.SALES_JOB.feed)
    return raw.groupBy("year", "month", "day", "venue_name").agg(
        F.sum(F.size("Sales").cast("bigint")).alias("sales")
    )


@register
def scan_json_inferred(spark, sf_dir):
    """The record schema taken from the files, levels from the directories."""
    root = fresh_dir(spark, "landing-rosters")
    _land(s.raw_rosters(spark, sf_dir), etl.ROSTERS_JOB.feed, root)
    raw = landing.read_landing(spark, root, etl.ROSTERS_JOB.feed, infer=True)
    return etl.readable(raw, etl.ROSTERS_JOB.feed)


@register
def sink_parquet_partitioned(spark, sf_dir):
    """Written twice with partition replacement, read once."""
    out = fresh_dir(spark, "rosters")
    keyed = s.rosters(spark, sf_dir).selectExpr(
        "*", "year(roster_start_time) AS year", "month(roster_start_time) AS month"
    )
    for _ in range(2):
        tables.write_table(keyed, out, ("year", "month"), mode="replace_partitions")
    return spark.read.parquet(out)


@register
def egm_extract(spark, sf_dir):
    """CSV in, five columns kept as they are and one renamed, CSV out, read back and typed."""
    landed, out = fresh_dir(spark, "egm-landing"), fresh_dir(spark, "egm")
    tables.write_csv(s.egm(spark, sf_dir), landed)
    tables.write_csv(landing.extract_egm(landing.read_egm_csv(spark, landed)), out)
    typed = landing.typed_egm(spark.read.option("header", True).csv(out))
    return typed.withColumnsRenamed({"EGM Turnover": "Turnover", "EGM Wins": "Wins"})


@register
def egm_unread(spark, sf_dir):
    """How many readings of each column are no values."""
    return landing.unread_egm(landing.extract_egm(s.egm(spark, sf_dir)))


@register
def incremental_ingest(spark, sf_dir):
    """Two landings, each followed by a load, and a load with nothing new."""
    root, out = fresh_dir(spark, "landing-timesheets"), fresh_dir(spark, "timesheets")
    checkpoint = fresh_dir(spark, "timesheets-checkpoint")
    raw = s.raw_timesheets(spark, sf_dir)
    early = F.col("Timesheet_Date") < "2000-01-16"
    for part in (raw.where(early), raw.where(~early), None):
        if part is not None:
            feed = etl.TIMESHEETS_JOB.feed
            part.write.mode("append").partitionBy(*feed.partitions).json(root)
        ingest.ingest_new_files(spark, etl.TIMESHEETS_JOB, root, out, checkpoint)
    return etl.read_table(spark, out, etl.TIMESHEETS_JOB)


@register
def upsert_sales(spark, sf_dir):
    """Sales loaded file by file, then one sale in nine sent again with another member name, the next day's directory."""
    root, out, checkpoint = (fresh_dir(spark, name) for name in ("landing-sales", "sales", "sales-checkpoint"))
    feed, key = etl.SALES_JOB.feed, "Sales_Details.Transaction_Id"
    raw = s.raw_sales_keyed(spark, sf_dir)
    _land(raw, feed, root)
    ingest.upsert_new_files(spark, etl.SALES_JOB, key, root, out, checkpoint)
    again = s.corrected_sales(raw)
    _land(again, feed, root, "append")
    for _ in range(2):
        ingest.upsert_new_files(spark, etl.SALES_JOB, key, root, out, checkpoint)
    sale = F.col("Sales_Details")
    return etl.read_table(spark, out, etl.SALES_JOB).select(
        "year", "month", "day", "venue_id",
        sale["Transaction_Id"].alias("transaction_id"),
        sale["Member_Name"].alias("member_name"),
        sale["Member_Points_Balance"].alias("points_balance"),
    )


@register
def pull_since_mark(spark, sf_dir):
    """Daily sums of the rows after a stored mark, with the mark to store next."""
    path = fresh_dir(spark, "mark")
    stored = spark.range(1).selectExpr("timestamp_ntz'2024-01-13 20:45:46.150' AS mark")
    ingest.write_mark(stored, path)
    mark = ingest.read_mark(spark, path).first()["mark"]
    new = ingest.rows_since(s.table(spark, sf_dir, "events"), "ts", mark)
    return new.groupBy("event_type").agg(
        F.sum("event_id").alias("id_sum"), F.max("ts").alias("next_mark")
    )


PULLED_AT = ("2024-01-08 00:00:00", "2024-01-09 12:00:00", "2024-01-16 06:00:00", "2024-03-01 00:00:00")


@register
def pull_overlapping(spark, sf_dir):
    """Events pulled four times, a day's and a week's delay among them: what was loaded, once each, and what came too late."""
    landed, out, checkpoint = (fresh_dir(spark, name) for name in ("pulls", "events", "events-checkpoint"))
    schema, mark = s.SCHEMAS["events"], None
    for at in PULLED_AT:
        there = s.events_seen(spark, sf_dir).where(F.col("seen_at") <= F.lit(at).cast("timestamp_ntz")).drop("seen_at")
        ingest.overlapping(there, "ts", mark, timedelta(days=9)).write.mode("append").parquet(landed)
        ingest.ingest_pulls(spark, landed, schema, "event_id", "ts", timedelta(days=2), out, checkpoint)
        mark = ingest.next_mark(spark.read.schema(schema).parquet(out), "ts").first()["mark"]
    loaded, pulled = (spark.read.schema(schema).parquet(path) for path in (out, landed))
    rows = loaded.select("event_type", "event_id", F.lit(0).alias("late"))
    rows = rows.unionByName(ingest.missed_rows(pulled, loaded, "event_id").select("event_type", "event_id", F.lit(1).alias("late")))
    return rows.groupBy("event_type").agg(
        F.count_if(F.col("late") == 0).alias("loaded"),
        F.sum(F.when(F.col("late") == 0, F.col("event_id"))).alias("id_sum"),
        F.count_if(F.col("late") == 1).alias("missed"),
    )


# --- jobs --------------------------------------------------------------------


@register
def etl_sales(spark, sf_dir):
    root, out = fresh_dir(spark, "landing-sales"), fresh_dir(spark, "sales")
    _land(s.raw_sales(spark, sf_dir, grouped=True), etl.SALES_JOB.feed, root, grouped=True)
    etl.run_job(spark, etl.SALES_JOB, root, out)
    sale = F.col("Sales_Details")
    return etl.read_table(spark, out, etl.SALES_JOB).select(
        "year", "month", "day", "venue_id", "venue_name",
        sale["Transaction_Id"].alias("transaction_id"),
        sale["Transaction_Date"].alias("transaction_date"),
        sale["Member_Id"].alias("member_id"),
        sale["Member_Name"].alias("member_name"),
        sale["Member_Account_Balance"].alias("account_balance"),
        sale["Member_Points_Balance"].alias("points_balance"),
        F.coalesce(F.size(sale["Items"]), F.lit(-1)).alias("items"),
        F.try_element_at(sale["Items"], F.lit(1))["Product_Name"].alias("first_product"),
    )


@register
def etl_sales_inferred(spark, sf_dir):
    """The nested record schema taken from the files, declared fields typed as declared."""
    root, out = fresh_dir(spark, "landing-sales"), fresh_dir(spark, "sales")
    _land(s.raw_sales(spark, sf_dir, grouped=True).withColumn("till", F.lit("T1")), etl.SALES_JOB.feed, root, grouped=True)
    etl.run_job(spark, etl.SALES_JOB, root, out, infer=True)
    kept = spark.read.parquet(out).where("till = 'T1'")
    return kept.groupBy("year", "month", "venue_id").agg(
        F.count(F.lit(1)).alias("sales"),
        F.sum("Sales_Details.Member_Points_Balance").alias("points"),
        F.sum(F.aggregate("Sales_Details.Items", F.lit(0).cast("decimal(22,2)"),
                          lambda n, x: (n + x["Total_Inc"]).cast("decimal(22,2)"))).alias("total_inc"),
    )


@register
def etl_reload_month(spark, sf_dir):
    """All sales loaded, landed a second time, and one month of them loaded again."""
    root, out = fresh_dir(spark, "landing-sales"), fresh_dir(spark, "sales")
    _land(s.raw_sales(spark, sf_dir, grouped=True), etl.SALES_JOB.feed, root, grouped=True)
    etl.run_job(spark, etl.SALES_JOB, root, out)
    _land_again(spark, etl.SALES_JOB.feed, root)
    etl.run_job(spark, etl.SALES_JOB, root, out, levels="year = 1998 AND month = 6")
    return etl.read_table(spark, out, etl.SALES_JOB).groupBy("year", "month").agg(F.count(F.lit(1)).alias("sales"))


@register
def etl_sales_rest(spark, sf_dir):
    """Fields that the feed does not name, out of a table loaded as declared, reloaded in part and compacted."""
    root, out, few = (fresh_dir(spark, name) for name in ("landing-sales", "sales", "sales-compacted"))
    _land(s.raw_sales_wide(spark, sf_dir, grouped=True), etl.SALES_JOB.feed, root, grouped=True)
    etl.run_job(spark, etl.SALES_JOB, root, out)
    etl.run_job(spark, etl.SALES_JOB, root, out, levels="year = 1998")
    tables.compact_table(spark, out, few, etl.SALES_JOB.feed.partitions)
    sale = F.col("Sales_Details")
    size = rest.rest_field(F.try_element_at(sale["Items"], F.lit(1))[rest.REST], "$.Size", "string")
    return etl.read_table(spark, few, etl.SALES_JOB, rest=True).select(
        "year", "month", "venue_id",
        sale["Transaction_Id"].alias("transaction_id"),
        sale["Member_Points_Balance"].alias("points_balance"),
        rest.rest_field(F.col(rest.REST), "$.region", "string").alias("region"),
        rest.rest_field(sale[rest.REST], "$.Clerk", "string").alias("clerk"),
        rest.rest_field(sale[rest.REST], "$.Till.no", "int").alias("till"),
        size.alias("first_size"),
    )


def _land_rosters(spark, sf_dir, root):
    lines = s.landed_rosters(spark, sf_dir)
    tables.rebalanced(lines, ("year", "month")).write.partitionBy("year", "month").text(root)


@register
def etl_rosters(spark, sf_dir):
    root, out = fresh_dir(spark, "landing-rosters"), fresh_dir(spark, "rosters")
    _land_rosters(spark, sf_dir, root)
    etl.run_job(spark, etl.ROSTERS_JOB, root, out)
    return etl.read_table(spark, out, etl.ROSTERS_JOB)


@register
def etl_rosters_audit(spark, sf_dir):
    """What the job counts, and the lines it set aside."""
    root, out = fresh_dir(spark, "landing-rosters"), fresh_dir(spark, "rosters")
    _land_rosters(spark, sf_dir, root)
    audit = etl.run_job(spark, etl.ROSTERS_JOB, root, out)
    set_aside = spark.read.schema("line string, year int, month int").parquet(etl.malformed_path(out))
    counts = [F.lit(audit[name]).cast("bigint").alias(name) for name in ("records", "rows", "malformed", "unparsed_times", "unparsed_values")]
    return set_aside.agg(F.count("line").alias("set_aside")).select("set_aside", *counts)


@register
def etl_timesheets(spark, sf_dir):
    root, out = fresh_dir(spark, "landing-timesheets"), fresh_dir(spark, "timesheets")
    _land(s.raw_timesheets(spark, sf_dir), etl.TIMESHEETS_JOB.feed, root)
    etl.run_job(spark, etl.TIMESHEETS_JOB, root, out)
    return etl.read_table(spark, out, etl.TIMESHEETS_JOB)


# --- sales and labour reports ------------------------------------------------


@register
def explode_sales(spark, sf_dir):
    """Sales and their value per landing month, from the unnested records."""
    sale = F.col("Sales_Details")
    return (
        items.explode_sales(s.raw_sales(spark, sf_dir))
        .groupBy("venue_name", "year", "month")
        .agg(
            F.sum(sale["Transaction_Id"]).alias("id_sum"),
            F.sum(sale["Member_Points_Balance"]).alias("points"),
        )
    )


@register
def explode_items(spark, sf_dir):
    sold = _items(spark, sf_dir).where(F.col("master_group_id") == reports.BEVERAGE_GROUP)
    return sold.select(
        "venue_id", "transaction_date", "member_id", "product_name", "quantity", "total_inc"
    )


@register
def beverage_sales_total(spark, sf_dir):
    return reports.beverage_sales_total(_items(spark, sf_dir), 1, "1996-05-01", "1999-05-17")


@register
def daily_sales(spark, sf_dir):
    return reports.daily_sales(_items(spark, sf_dir), "venue_id")


@register
def daily_wages(spark, sf_dir):
    return reports.daily_wages(s.timesheets(spark, sf_dir), "location_name")


@register
def daily_sales_vs_wages(spark, sf_dir):
    return reports.daily_sales_vs_wages(
        _items(spark, sf_dir), s.timesheets(spark, sf_dir), VENUE_ID, FIRST_DAY, LAST_DAY,
        venues=s.venues(spark, sf_dir),
    )


@register
def shift_overlap(spark, sf_dir):
    return shifts.shifts_on(shifts.timesheet_shifts(s.timesheets(spark, sf_dir)), SHIFT_DAY)


@register
def backward_shifts(spark, sf_dir):
    return shifts.backward_shifts(shifts.roster_shifts(s.rosters(spark, sf_dir)))


@register
def hourly_wages(spark, sf_dir):
    """Worked cost per venue and hour over all shifts."""
    return shifts.hourly_cost(
        shifts.timesheet_shifts(s.timesheets(spark, sf_dir)), keys=["location_name"]
    )


@register
def hourly_roster_vs_timesheet(spark, sf_dir):
    return reports.hourly_roster_vs_timesheet(
        s.rosters(spark, sf_dir), s.timesheets(spark, sf_dir), VENUE, SHIFT_DAY
    )


@register
def hourly_roster_vs_timesheet_clipped(spark, sf_dir):
    return reports.hourly_roster_vs_timesheet(
        s.rosters(spark, sf_dir), s.timesheets(spark, sf_dir), VENUE, SHIFT_DAY, clip=True
    )


@register
def total_roster_vs_timesheet(spark, sf_dir):
    return reports.total_roster_vs_timesheet(
        s.rosters(spark, sf_dir), s.timesheets(spark, sf_dir), VENUE, "1999-12-01", "2000-05-17"
    )


@register
def top_products(spark, sf_dir):
    return reports.top_products(_items(spark, sf_dir), AS_OF)


@register
def member_spend(spark, sf_dir):
    return reports.member_spend(s.sales(spark, sf_dir), FIRST_DAY, LAST_DAY)


@register
def venue_dimension(spark, sf_dir):
    """Timesheets carry no venue id; the sales know which name has which."""
    names = items.venue_dimension(s.sales(spark, sf_dir))
    return (
        s.timesheets(spark, sf_dir)
        .join(names, F.col("location_name") == F.col("venue_name"))
        .groupBy("venue_id", "venue_name")
        .agg(F.sum("timesheet_cost").alias("wages"))
    )


def _auto_grain(spark, sf_dir, start, end):
    return grain.auto_grain_report(
        _items(spark, sf_dir), s.timesheets(spark, sf_dir), s.rosters(spark, sf_dir),
        VENUE_ID, start, end, venues=s.venues(spark, sf_dir),
    )


@register
def auto_grain_total(spark, sf_dir):
    return _auto_grain(spark, sf_dir, "1999-12-01", "2000-05-17")


@register
def auto_grain_day(spark, sf_dir):
    return _auto_grain(spark, sf_dir, *MONTH)


@register
def auto_grain_hour(spark, sf_dir):
    return _auto_grain(spark, sf_dir, SHIFT_DAY, SHIFT_DAY)


@register
def auto_grain_report(spark, sf_dir):
    """The same report asked for half a year, a month and a day."""
    ranges = (("1999-12-01", "2000-05-17"), MONTH, (SHIFT_DAY, SHIFT_DAY))
    whole, daily, hourly = (_auto_grain(spark, sf_dir, *r) for r in ranges)
    return whole.unionByName(daily).unionByName(hourly)


@register
def rollup_ranges(spark, sf_dir):
    """Fifty ranges of minutes to years out of stored sums."""
    path = fresh_dir(spark, "rollups")
    feeds = rollup.Feeds(_items(spark, sf_dir), s.timesheets(spark, sf_dir), s.rosters(spark, sf_dir))
    rollup.build_rollups(feeds, path)
    begin = datetime(1996, 1, 1, 0, 7)
    starts = [begin + timedelta(days=29 * k, minutes=37 * k) for k in range(50)]
    ranges = [rollup.Range(k, f"NATION_{k % 25}", a, a + timedelta(days=k * k // 2, minutes=11 * k + 5)) for k, a in enumerate(starts)]
    return rollup.range_totals(spark, path, feeds, ranges)


@register
def dashboard_daily(spark, sf_dir):
    return dashboard.dashboard_daily(
        _items(spark, sf_dir), s.timesheets(spark, sf_dir), s.rosters(spark, sf_dir),
        _egm(spark, sf_dir), FIRST_DAY, LAST_DAY, venues=s.venues(spark, sf_dir),
    )


@register
def dashboard_upkeep(spark, sf_dir):
    """The stored dashboard after the feeds have come in two parts, each followed by a refresh."""
    root, out, state = (fresh_dir(spark, name) for name in ("feeds", "dashboard", "dashboard-state"))
    feeds = {
        "items": _items(spark, sf_dir).where("sale_date IS NOT NULL"),
        "timesheets": s.timesheets(spark, sf_dir).withColumn("day", F.to_date("timesheet_date")),
        "rosters": s.rosters(spark, sf_dir).withColumn("day", F.to_date("roster_start_time")),
        "egm": _egm(spark, sf_dir).withColumn("day", F.trunc("Date", "month")).withColumnsRenamed({"EGM Turnover": "turnover", "EGM Wins": "wins"}),
    }
    levels = {"items": "year", "timesheets": "day", "rosters": "day", "egm": "day"}
    feeds["items"] = feeds["items"].withColumn("year", F.year("sale_date"))
    early = {"items": "year < 1998", "timesheets": "day < '2000-01-16'", "rosters": "day < '2000-01-20'", "egm": "Date < '2000-01-12'"}
    for part in (True, False):
        for name, frame in feeds.items():
            own = frame.where(early[name] if part else f"NOT ({early[name]})")
            tables.write_table(own, f"{root}/{name}", [levels[name]])
        stored = {name: spark.read.schema(frame.schema).parquet(f"{root}/{name}") for name, frame in feeds.items()}
        stored["egm"] = stored["egm"].withColumnsRenamed({"turnover": "EGM Turnover", "wins": "EGM Wins"})
        days = {"items": "sale_date", "timesheets": "day", "rosters": "day", "egm": "Date"}
        sources = {name: upkeep.Source(frame, [levels[name]], F.col(days[name])) for name, frame in stored.items()}
        upkeep.refresh_dashboard(spark, sources, s.venues(spark, sf_dir), out, state)
    return upkeep.read_dashboard(spark, out).where(F.col("date").between(FIRST_DAY, LAST_DAY))


# --- SQL surface -------------------------------------------------------------

HOURLY_PLAN = per_hour("venue_lake.rosters", "roster_start_time", "roster_end_time", "roster_cost", "roster_wages")


def _ask(spark: SparkSession, sql: str, **parameters: object) -> DataFrame:
    outcome = run_sql(spark, sql, **parameters)
    if outcome.frame is None:
        raise ValueError(outcome.message)
    return outcome.frame


def _ask_worked(spark: SparkSession, sf_dir: str, name: str, **parameters: object) -> DataFrame:
    views = {"sales": s.sales, "timesheets": s.timesheets, "rosters": s.rosters}
    tables.register_views({view: make(spark, sf_dir) for view, make in views.items()})
    return _ask(spark, WORKED_SQL[name], **parameters)


@register
def sql_surface(spark, sf_dir):
    return _ask_worked(
        spark, sf_dir, "beverage_sales_total", venue_id=1, start="1996-05-01", stop="1999-05-18"
    )


@register
def sql_daily_sales_vs_wages(spark, sf_dir):
    return _ask_worked(
        spark, sf_dir, "daily_sales_vs_wages", venue_id=VENUE_ID, start=FIRST_DAY, stop="2002-01-01"
    )


@register
def sql_hourly_roster_vs_timesheet(spark, sf_dir):
    return _ask_worked(
        spark, sf_dir, "hourly_roster_vs_timesheet", location=VENUE, start=SHIFT_DAY, stop="2000-01-18"
    )


@register
def sql_total_roster_vs_timesheet(spark, sf_dir):
    return _ask_worked(
        spark, sf_dir, "total_roster_vs_timesheet", location=VENUE, start="1999-12-01", stop="2000-05-18"
    )


@register
def sql_top_products(spark, sf_dir):
    return _ask_worked(spark, sf_dir, "top_products", as_of=AS_OF)


@register
def sql_questions(spark, sf_dir):
    """Worked questions called and joined inside a larger query."""
    views = {"sales": s.sales, "timesheets": s.timesheets, "rosters": s.rosters}
    tables.register_views({view: make(spark, sf_dir) for view, make in views.items()})
    register_questions(spark)
    return _ask(
        spark,
        """SELECT d.date, d.sales - d.wages AS margin, b.beverage_sale_inc, t.roster_wages, p.product_name, p.total_quantity
        FROM daily_sales_vs_wages(venue_id => 2, start => :start, stop => :stop) AS d
        CROSS JOIN beverage_sales_total(venue_id => 2, start => :start, stop => :stop) AS b
        CROSS JOIN total_roster_vs_timesheet(location => 'NATION_2', start => '1999-12-01', stop => '2000-05-18') AS t
        JOIN top_products(as_of => '2000-03-31 12:00:00') AS p ON p.total_quantity > 0
        WHERE d.sales > d.wages;""",
        start=FIRST_DAY, stop="2002-01-01",
    )


@register
def sql_lake_tables(spark, sf_dir):
    """Rosters loaded by their job, put into the catalog and asked by full name."""
    root, out = fresh_dir(spark, "landing-rosters"), fresh_dir(spark, "rosters")
    _land_rosters(spark, sf_dir, root)
    etl.run_job(spark, etl.ROSTERS_JOB, root, out)
    tables.register_lake(spark, "venue_lake", fresh_dir(spark, "lake"), {"rosters": out})
    return _ask(spark, HOURLY_PLAN, location=VENUE, start="1900-01-01", stop="2100-01-01")


@register
def compacted_rosters(spark, sf_dir):
    """Rosters in many small files, merged where the catalog points to; cost and files by month."""
    out, lake = fresh_dir(spark, "rosters"), fresh_dir(spark, "lake")
    keyed = s.rosters(spark, sf_dir).selectExpr("*", "year(roster_start_time) AS year", "month(roster_start_time) AS month")
    keyed.repartition(6).write.partitionBy("year", "month").parquet(out)
    tables.register_lake(spark, "venue_lake", lake, {"scattered": out})
    before = tables.directory_files(spark.table("venue_lake.scattered"), ["year", "month"]).selectExpr("year", "month", "files > 1 AS scattered")
    path = fresh_dir(spark, "files-before")
    before.write.parquet(path)
    tables.compact_lake(spark, "venue_lake.scattered", f"{lake}/compacted")
    whole = spark.table("venue_lake.scattered")
    sums = whole.groupBy("year", "month").agg(F.count(F.lit(1)).alias("shifts"), F.sum("roster_cost").alias("cost"))
    files = tables.directory_files(whole, ["year", "month"]).select("year", "month", "files")
    return sums.join(files, ["year", "month"]).join(spark.read.parquet(path), ["year", "month"])


# --- text, vectors, access ---------------------------------------------------


@register
def extract_sql_reply(spark, sf_dir):
    reply = F.col("text")
    return s.replies(spark, sf_dir).select(
        "conv_id",
        "turn",
        text.reply_status(reply).alias("status"),
        text.reply_message(reply).alias("message"),
        text.reply_status(reply, strict=True).alias("strict_status"),
        text.reply_message(reply, strict=True).alias("strict_message"),
    )


@register
def flatten_documents(spark, sf_dir):
    return context.flatten_documents(s.indented_documents(spark, sf_dir))


@register
def document_context(spark, sf_dir):
    return context.context_pages(s.indented_documents(spark, sf_dir))


@register
def context_ranges(spark, sf_dir):
    """Two thousand bytes around the beginning of every twentieth document, out of the stored whole context."""
    path, docs = fresh_dir(spark, "context"), s.indented_documents(spark, sf_dir)
    context.write_addressable(docs, path, chunk=1 << 20)
    places = context.document_places(docs).where("doc_id % 20 = 0")
    begin = F.greatest(F.col("begin") - 1000, F.lit(0))
    ranges = places.select(F.col("doc_id").alias("range_id"), begin.alias("begin"), (F.col("begin") + 1000).alias("stop"))
    found = context.read_ranges(spark, path, ranges, chunk=1 << 20)
    return found.select(F.col("range_id").alias("doc_id"), F.octet_length("bytes").cast("bigint").alias("n"), F.hex("bytes").alias("bytes"))


@register
def whole_file_documents(spark, sf_dir):
    """Pages of documents as files, each read as one text and flattened."""
    root = fresh_dir(spark, "documents")
    context.write_pages(s.indented_documents(spark, sf_dir), root)
    return context.flatten_documents(context.read_pages(spark, root), "value")


@register
def embedding_topk(spark, sf_dir):
    """The ten nearest of all vectors to every vector whose id 20 divides, itself included."""
    vectors = s.table(spark, sf_dir, "embeddings")
    found = nearest.nearest(vectors.select("vec_id", "embedding"), _asked(vectors), 10)
    return found.withColumn("distance", F.round("distance", 6))


def _asked(vectors: DataFrame) -> DataFrame:
    """The query set: all vectors whose id 20 divides."""
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _indexed(spark, sf_dir):
    """An index that was built over all vectors and loaded again, and the query set."""
    path = fresh_dir(spark, "vector-index")
    vectors = s.table(spark, sf_dir, "embeddings")
    vector_index.build_index(vectors, path)
    return vector_index.load_index(spark, path), _asked(vectors)


@register
def index_search(spark, sf_dir):
    """The same neighbours out of a stored index, exactly."""
    index, asked = _indexed(spark, sf_dir)
    return vector_index.search(index, asked, 10).withColumn("distance", F.round("distance", 6))


@register
def index_recall(spark, sf_dir):
    """Neighbours that the query set has, and whether a search of some lists, their number tuned on 256 other queries, finds nine in ten."""
    index, asked = _indexed(spark, sf_dir)
    others = s.table(spark, sf_dir, "embeddings").where("vec_id % 20 = 10").select(F.col("vec_id").alias("query_id"), "embedding")
    probes = vector_index.probes_for(index, others.orderBy(F.xxhash64("query_id")).limit(256), 10, 0.95)
    fast, exact = (vector_index.search(index, asked, 10, n) for n in (probes, None))
    return vector_index.recall(fast, exact).select("neighbours", (F.col("recall") >= 0.9).alias("enough"))


@register
def embedding_search(spark, sf_dir):
    """Vectors saved twice under one version and once under an older one, the latest loaded and searched."""
    root = fresh_dir(spark, "vectors")
    vectors = s.table(spark, sf_dir, "embeddings")
    older, replaced = (vectors.withColumn("embedding", F.transform("embedding", lambda x: (x * n).cast("float"))) for n in (2, 3))
    snapshots.save_vectors(older, root, "text:v1", "2024-05-13 20:45:46")
    for saved in (replaced, vectors):
        snapshots.save_vectors(saved, root, "text:v1", "2024-06-02 08:00:00")
    loaded = snapshots.load_vectors(spark, root, "text:v1")
    found = nearest.nearest(loaded.select("vec_id", "embedding"), _asked(loaded), 3)
    version = loaded.select("version").distinct()
    return found.withColumn("distance", F.round("distance", 6)).withColumn("version", version.scalar())


@register
def embedding_changes(spark, sf_dir):
    """A whole version, two sets of changes, folded into one, and its neighbours of the query set."""
    root = fresh_dir(spark, "vectors")
    vectors = s.table(spark, sf_dir, "embeddings")
    turned = vectors.where("vec_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: (-x).cast("float")))
    snapshots.save_vectors(vectors, root, "text:v1", "2024-05-13 20:45:46")
    snapshots.save_changes(turned, vectors.where("vec_id % 11 = 0"), root, "text:v1", "2024-05-20 08:00:00")
    snapshots.save_changes(vectors.where("vec_id % 22 = 0"), vectors.where("vec_id % 13 = 0"), root, "text:v1", "2024-06-02 08:00:00")
    snapshots.fold_vectors(spark, root, "text:v1")
    loaded = snapshots.load_vectors(spark, root, "text:v1")
    found = nearest.nearest(loaded.select("vec_id", "embedding"), _asked(vectors), 3)
    return found.withColumn("distance", F.round("distance", 6)).withColumn("version", loaded.select("version").distinct().scalar())


@register
def embedding_snapshot(spark, sf_dir):
    """Two versions of one model and one of another; the latest is loaded."""
    root = fresh_dir(spark, "vectors")
    vectors = s.table(spark, sf_dir, "embeddings")
    relabeled = vectors.withColumn("label", F.col("label") + 100)
    snapshots.save_vectors(vectors, root, "text:v1", "2024-05-13 20:45:46")
    snapshots.save_vectors(relabeled, root, "text:v1", "2024-06-02 08:00:00")
    snapshots.save_vectors(vectors, root, "other", "2024-07-01 00:00:00")
    return snapshots.load_vectors(spark, root, "text:v1").select(
        "model_id", "version", "vec_id", "label",
        F.try_element_at("embedding", F.lit(1)).cast("double").alias("first"),
    )


@register
def role_gate(spark, sf_dir):
    return access.with_decision(s.requests(spark, sf_dir), s.user_role(spark, sf_dir))


@register
def role_gate_allowed(spark, sf_dir):
    return access.allowed_requests(s.requests(spark, sf_dir), s.user_role(spark, sf_dir))


@register
def role_gate_refused(spark, sf_dir):
    return access.refused_requests(s.requests(spark, sf_dir), s.user_role(spark, sf_dir))
