"""Venue feeds derived from the given tables.

Venues are nations. A sale is an order line rung up by the order's customer, its
items are the line's product and, for some, a companion item; every record is
built from its own row, so no order, customer or day is ever gathered in one
place, however many rows share it. Shifts and machine readings are events, moved
back to the years of the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.timeparse import WITH_MILLIS, WITHOUT_MILLIS
from tallyhouse.sources.tables import rebalanced

# The given tables; stating the columns saves a job per read.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str) -> str:
    return f"cast({column} AS decimal(12,2))"


# The line's product and its companion: name, group, quantity and amount.
_LINE = ("p_name", "p_size % 6", "l_quantity", "l_extendedprice")
_COMPANION = ("p_brand", "(p_size + 1) % 6", "1", "p_retailprice")
_SOLD_AT = "o_orderdate + (l_orderkey % 1440) * INTERVAL '1' MINUTE"
LANDED_BY = ("year", "month", "day")


def _item(item: tuple[str, str, str, str], more: str = "") -> str:
    name, group, quantity, total = item
    return f"""named_struct('Product_Name', {name}, 'Master_Group_Id', {group},
        'Quantity', {_money(quantity)}, 'Total_Inc', {_money(total)}{more.format(name=name)})"""


def _items(line: str, companion: str) -> str:
    """0 to 2 of the two items; one line number in seven has no array at all."""
    return f"""CASE WHEN l_linenumber = 6 THEN NULL
        ELSE slice(array({line}, {companion}), 1, l_linenumber % 3) END"""


def _sale_struct(sale_id: str, sold_at: str, items: str, more: str = "") -> str:
    return f"""named_struct('Transaction_Id', {sale_id}, 'Transaction_Date', {sold_at},
        'Member_Id', o_custkey, 'Member_Name', c_name,
        'Member_Account_Balance', {_money("c_acctbal")},
        'Member_Points_Balance', {_money("o_totalprice")}, 'Items', {items}{more})"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order, customer and part: customers meet orders, parts meet lines, and then these two each other once."""
    lineitem, orders, customer, nation, part = (
        table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "part")
    )
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ordered = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    sold = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return sold.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lake's sales table: a row per sale; one order in seven has sales without an id."""
    return _lines(spark, sf_dir).selectExpr(
        "c_nationkey AS venue_id",
        "n_name AS venue_name",
        _sale_struct("nullif(l_orderkey, l_orderkey div 7 * 7)", _SOLD_AT, _items(_item(_LINE), _item(_COMPANION))) + " AS Sales_Details",
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS venue_id", "n_name AS venue_name"
    )


def _landed_lines(spark: SparkSession, sf_dir: str, grouped: bool) -> DataFrame:
    """Order lines with the levels of the directory they land in, put together by directory if asked for.

    Rows of a directory come together here, before records are made of them: a
    record repeats its order and customer in each sale and has names for all fields.
    """
    landed = "add_months(trunc(o_orderdate, 'MM'), 1)"
    lines = _lines(spark, sf_dir).selectExpr("*", f"year({landed}) AS year", f"month({landed}) AS month", f"day({landed}) AS day")
    return rebalanced(lines, LANDED_BY).sortWithinPartitions(*LANDED_BY) if grouped else lines


def _raw_sales(lines: DataFrame, more_of_sale: str = "", more_of_item: str = "", more: tuple[str, ...] = ()) -> DataFrame:
    """Records of 0 to 2 sales out of lines, with further fields if given.

    ``more_of_sale`` speaks of its sale as ``{id}``, ``more_of_item`` of its item as ``{name}``.
    """
    line, companion = (_item(item, more_of_item) for item in (_LINE, _COMPANION))
    first = f"""CASE WHEN l_orderkey % 101 = 0 THEN 'unknown'
        ELSE date_format({_SOLD_AT}, "{WITH_MILLIS}") END"""
    second = f"""date_format({_SOLD_AT} + INTERVAL '45:00.250' MINUTE TO SECOND, "{WITH_MILLIS}")"""
    both = [
        _sale_struct("l_orderkey * 2", first, _items(line, companion), more_of_sale.format(id="(l_orderkey * 2)")),
        _sale_struct("l_orderkey * 2 + 1", second, f"array({companion})", more_of_sale.format(id="(l_orderkey * 2 + 1)")),
    ]
    return lines.selectExpr(
        "c_nationkey AS venue_id",
        "n_name AS venue_name",
        f"slice(array({', '.join(both)}), 1, cast(l_orderkey % 3 AS int)) AS Sales",
        *more,
        *LANDED_BY,
    )


def raw_sales(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """Records as landed: 0 to 2 sales each, times as text, by landing day.

    The sales of a month land on the first of the next, so landing and business
    dates differ. The second sale of a record happens 45 minutes and 250
    milliseconds after the first and has the companion item only. One order in
    101 carries text that is no time. ``grouped`` records come together by landing
    directory.
    """
    return _raw_sales(_landed_lines(spark, sf_dir, grouped))


def raw_sales_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one sale each, an order with its id, by landing month; every fifth has no id."""
    landed = "add_months(trunc(o_orderdate, 'MM'), 1)"
    sale_id, sold = "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END", f"""date_format(o_orderdate, "{WITH_MILLIS}")"""
    item = f"""array(named_struct('Product_Name', o_orderpriority, 'Master_Group_Id', 1,
        'Quantity', {_money("1")}, 'Total_Inc', {_money("o_totalprice")}))"""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    sold_by = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return sold_by.selectExpr(
        "c_nationkey AS venue_id", "n_name AS venue_name", f"array({_sale_struct(sale_id, sold, item)}) AS Sales",
        f"year({landed}) AS year", f"month({landed}) AS month", f"day({landed}) AS day",
    )


def corrected_sales(raw: DataFrame) -> DataFrame:
    """Every ninth sale that has an id, with another member name, as it lands a day later."""
    fixed = "transform(Sales, sale -> named_struct({}))".format(
        ", ".join(
            f"'{c}', " + ("concat(sale.Member_Name, ' *')" if c == "Member_Name" else f"sale.{c}")
            for c in (
                "Transaction_Id", "Transaction_Date", "Member_Id", "Member_Name",
                "Member_Account_Balance", "Member_Points_Balance", "Items",
            )
        )
    )
    return raw.where("Sales[0].Transaction_Id % 9 = 0").selectExpr("venue_id", "venue_name", f"{fixed} AS Sales", "year", "month", "day + 1 AS day")


def raw_sales_wide(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """The same records with fields that the feed does not name, at every level; some records lack them."""
    of_sale = """, 'Clerk', CASE WHEN {id} div 2 % 4 <> 0 THEN concat('C', {id} % 50) END,
        'Till', named_struct('no', {id} % 9)"""
    of_item = ", 'Size', concat('S', length({name}) % 4)"
    region = "CASE WHEN c_nationkey % 3 <> 0 THEN concat('R', c_nationkey) END AS region"
    return _raw_sales(_landed_lines(spark, sf_dir, grouped), of_sale, of_item, (region,))


def _shift_events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    begun = "cast(date_trunc('minute', ts - INTERVAL '24' YEAR) AS timestamp_ntz) AS s"
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).selectExpr("*", begun)


# A shift of a year or more and one that ends before it starts, now and then; the others count up to ten hours.
_SHIFT_MINUTES = "CASE event_id % 211 WHEN 7 THEN 527000 + event_id WHEN 9 THEN -150 ELSE 15 + event_id % 600 END"


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shift_events(spark, sf_dir, "purchase").selectExpr(
        "event_id",
        "concat('NATION_', user_id % 25) AS location_name",
        "s AS roster_start_time",
        f"s + ({_SHIFT_MINUTES}) * INTERVAL '1' MINUTE AS roster_end_time",
        f"{_money('value')} AS roster_cost",
    )


def timesheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third shift was never clocked."""
    clocked = "CASE WHEN event_id % 3 <> 0 THEN s + {} * INTERVAL '1' MINUTE END"
    return _shift_events(spark, sf_dir, "signup").selectExpr(
        "event_id",
        "concat('NATION_', user_id % 25) AS location_name",
        "cast(cast(s AS date) AS timestamp_ntz) AS timesheet_date",
        "s AS pay_start_time",
        f"s + ({_SHIFT_MINUTES}) * INTERVAL '1' MINUTE AS pay_end_time",
        clocked.format("7") + " AS clocked_start_time",
        clocked.format("(20 + event_id % 600)") + " AS clocked_end_time",
        f"{_money('value')} AS timesheet_cost",
    )


def raw_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text; one end time in 97 is empty."""
    return rosters(spark, sf_dir).selectExpr(
        "location_name",
        f'date_format(roster_start_time, "{WITHOUT_MILLIS}") AS Roster_Start_Time',
        f"""CASE WHEN event_id % 97 = 0 THEN ''
            ELSE date_format(roster_end_time, "{WITHOUT_MILLIS}") END AS Roster_End_Time""",
        "roster_cost",
        "year(roster_start_time) AS year",
        "month(roster_start_time) AS month",
    )


def landed_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters as feeds really come: one cost in 83 has a decimal comma, one line in 89 is cut off.

    ``line`` is what lies in the landing file.
    """
    rows = rosters(spark, sf_dir).selectExpr("event_id", "year(roster_start_time) AS year", "month(roster_start_time) AS month")
    raw = rosters(spark, sf_dir).selectExpr(
        "event_id AS id",
        f"""to_json(named_struct('location_name', location_name,
            'Roster_Start_Time', date_format(roster_start_time, "{WITHOUT_MILLIS}"),
            'Roster_End_Time', CASE WHEN event_id % 97 = 0 THEN ''
                ELSE date_format(roster_end_time, "{WITHOUT_MILLIS}") END,
            'roster_cost', CASE WHEN event_id % 83 = 0 THEN '12,50' ELSE cast(roster_cost AS string) END)) AS whole""",
    )
    return rows.join(raw, F.col("event_id") == F.col("id")).selectExpr(
        "CASE WHEN event_id % 89 = 0 THEN left(whole, 40) ELSE whole END AS line", "year", "month"
    )


def raw_timesheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid and clocked times come with and without milliseconds."""
    either = f"""CASE WHEN event_id % 2 = 0 THEN date_format({{0}}, "{WITH_MILLIS}")
        ELSE date_format({{0}}, "{WITHOUT_MILLIS}") END"""
    plain = f'date_format({{0}}, "{WITHOUT_MILLIS}")'
    return timesheets(spark, sf_dir).selectExpr(
        "location_name",
        plain.format("timesheet_date") + " AS Timesheet_Date",
        plain.format("timesheet_date + INTERVAL '7' DAY") + " AS Pay_Date",
        either.format("pay_start_time") + " AS Pay_Start_Time",
        either.format("pay_end_time") + " AS Pay_End_Time",
        either.format("clocked_start_time") + " AS Clocked_Start_Time",
        either.format("clocked_end_time") + " AS Clocked_End_Time",
        plain.format("pay_start_time") + " AS Roster_Start_Time",
        plain.format("pay_end_time") + " AS Roster_End_Time",
        "timesheet_cost",
        "year(timesheet_date) AS year",
        "month(timesheet_date) AS month",
    )


def egm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine readings as text in the CSV feed, with two columns nobody keeps.

    One date in three has the day first, one amount in four a comma between
    thousands, and one reading in 79 has a mark instead of its wins.
    """
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'click'")
        .selectExpr(
            "event_id AS Serial",
            "cast(user_id % 25 AS int) AS Venue",
            """date_format(ts - INTERVAL '24' YEAR,
                CASE WHEN event_id % 3 = 0 THEN 'dd/MM/yyyy' ELSE 'yyyy-MM-dd' END) AS Date""",
            "date_format(ts, 'HH:mm:ss') AS Time",
            """CASE WHEN event_id % 4 = 0 THEN format_number(cast(value * 10 AS decimal(14,2)), 2)
                ELSE cast(cast(value * 10 AS decimal(14,2)) AS string) END AS `EGM Turnover`""",
            "CASE WHEN event_id % 79 = 0 THEN 'n/a' ELSE cast(cast(value AS decimal(14,2)) AS string) END AS `EGM Wins`",
            "event_type AS Kind",
        )
    )


def events_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time a pull can first see them: one in ten a day late, one in 97 a week."""
    delay = "CASE WHEN event_id % 97 = 5 THEN 7 WHEN event_id % 10 = 3 THEN 1 ELSE 0 END"
    return table(spark, sf_dir, "events").selectExpr("*", f"ts + ({delay}) * INTERVAL '1' DAY AS seen_at")


def user_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role per supplier number; most users of the events have none."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('user_', s_suppkey) AS username",
        "CASE s_nationkey % 3 WHEN 0 THEN 'analysis' WHEN 1 THEN 'admin' ELSE 'staff' END AS role",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('user_', user_id) AS username"
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns reshaped into refusals, fenced, bare and missing answers."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        r"""CASE WHEN conv_id % 13 = 5 THEN NULL WHEN turn % 5 = 0 THEN concat('NO\n', text)
            WHEN turn % 2 = 0 THEN concat('Here:\n```sql\nselect ', conv_id, '\nfrom sales\n```\n', text)
            WHEN turn % 3 = 0 THEN concat('select ', turn, '\nwhere a is NOT null')
            ELSE concat('  select ', conv_id, '\n  from sales ') END AS text""",
    )


def indented_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the indentation and braces the given texts lack."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source", r"replace(text, '. ', '.\n   {') AS text"
    )
