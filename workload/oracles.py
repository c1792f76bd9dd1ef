"""DuckDB SQL giving the same rows as each registered query.

Written from the feeds' meaning rather than from the Spark plans: items are a
UNION ALL instead of an unnested array, shifts are spread one by one instead of
in pre-summed blocks, merged reports are full joins.
"""

from __future__ import annotations

MONEY = "decimal(12,2)"

# --- the feeds ---------------------------------------------------------------

LINES = """lines AS (
  SELECT *, c_nationkey AS venue_id, n_name AS venue_name,
         o_orderdate + (l_orderkey % 1440) * INTERVAL 1 MINUTE AS sold_at,
         date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS landed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

ITEMS = f"""{LINES}, items AS (
  SELECT venue_id, venue_name, sold_at AS transaction_date, o_custkey AS member_id, c_name AS member_name,
         p_name AS product_name, p_size % 6 AS master_group_id,
         CAST(l_quantity AS {MONEY}) AS quantity, CAST(l_extendedprice AS {MONEY}) AS total_inc
  FROM lines WHERE l_linenumber % 3 > 0
  UNION ALL
  SELECT venue_id, venue_name, sold_at, o_custkey, c_name, p_brand, (p_size + 1) % 6,
         CAST(1 AS {MONEY}), CAST(p_retailprice AS {MONEY})
  FROM lines WHERE l_linenumber % 3 = 2)"""

RAW_SALES = f"""{LINES}, raw_sales AS (
  SELECT year(landed) AS year, month(landed) AS month, day(landed) AS day,
         venue_id, venue_name, l_orderkey * 2 AS transaction_id,
         CASE WHEN l_orderkey % 101 <> 0 THEN sold_at END AS transaction_date,
         o_custkey AS member_id, c_name AS member_name,
         CAST(c_acctbal AS {MONEY}) AS account_balance, CAST(o_totalprice AS {MONEY}) AS points_balance,
         CASE WHEN l_linenumber = 6 THEN -1 ELSE l_linenumber % 3 END AS items,
         CASE WHEN l_linenumber % 3 > 0 THEN p_name END AS first_product
  FROM lines WHERE l_orderkey % 3 > 0
  UNION ALL
  SELECT year(landed), month(landed), day(landed), venue_id, venue_name, l_orderkey * 2 + 1,
         sold_at + INTERVAL 45 MINUTE + INTERVAL 250 MILLISECOND, o_custkey, c_name,
         CAST(c_acctbal AS {MONEY}), CAST(o_totalprice AS {MONEY}), 1, p_brand
  FROM lines WHERE l_orderkey % 3 = 2)"""

# A shift of a year or more and one that ends before it starts, now and then; the others count up to ten hours.
SHIFT_MINUTES = "CASE event_id % 211 WHEN 7 THEN 527000 + event_id WHEN 9 THEN -150 ELSE 15 + event_id % 600 END"

ROSTERS = f"""rosters AS (
  SELECT event_id, 'NATION_' || (user_id % 25) AS location_name, s AS roster_start_time,
         s + ({SHIFT_MINUTES}) * INTERVAL 1 MINUTE AS roster_end_time, CAST(value AS {MONEY}) AS roster_cost
  FROM (SELECT *, date_trunc('minute', ts - INTERVAL 24 YEAR) AS s FROM events) e
  WHERE event_type = 'purchase')"""

TIMESHEETS = f"""timesheets AS (
  SELECT event_id, 'NATION_' || (user_id % 25) AS location_name, date_trunc('day', s)::timestamp AS timesheet_date,
         s AS pay_start_time, s + ({SHIFT_MINUTES}) * INTERVAL 1 MINUTE AS pay_end_time,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE s + INTERVAL 7 MINUTE END AS clocked_start_time,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE s + (20 + event_id % 600) * INTERVAL 1 MINUTE END
           AS clocked_end_time,
         CAST(value AS {MONEY}) AS timesheet_cost
  FROM (SELECT *, date_trunc('minute', ts - INTERVAL 24 YEAR) AS s FROM events) e
  WHERE event_type = 'signup')"""

EGM = """egm AS (
  SELECT CAST(user_id % 25 AS int) AS Venue_Id, CAST(ts - INTERVAL 24 YEAR AS date) AS Date,
         strftime(ts, '%H:%M:%S') AS Time,
         CAST(value * 10 AS decimal(14,2)) AS turnover,
         CASE WHEN event_id % 79 <> 0 THEN CAST(value AS decimal(14,2)) END AS wins
  FROM events WHERE event_type = 'click')"""

USER_ROLE = """user_role AS (
  SELECT 'user_' || s_suppkey AS username,
         CASE s_nationkey % 3 WHEN 0 THEN 'analysis' WHEN 1 THEN 'admin' ELSE 'staff' END AS role
  FROM supplier), requests AS (SELECT event_id, 'user_' || user_id AS username FROM events)"""

REPLIES = """replies AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 13 = 5 THEN NULL
    WHEN turn % 5 = 0 THEN 'NO' || chr(10) || text
    WHEN turn % 2 = 0 THEN 'Here:' || chr(10) || '```sql' || chr(10) || 'select ' || conv_id || chr(10)
      || 'from sales' || chr(10) || '```' || chr(10) || text
    WHEN turn % 3 = 0 THEN 'select ' || turn || chr(10) || 'where a is NOT null'
    ELSE '  select ' || conv_id || chr(10) || '  from sales ' END AS text
  FROM conversations)"""

DOCS = """docs AS (
  SELECT doc_id, source, replace(text, '. ', '.' || chr(10) || '   {') AS text FROM documents)"""


def flat(text: str) -> str:
    """The text without line feeds and their indentation, braces doubled."""
    for width in range(20, -1, -1):
        text = f"replace({text}, chr(10) || '{' ' * width}', '')"
    return f"replace(replace({text}, '{{', '{{{{'), '}}', '}}}}')"


# Shifts of either feed: start, end, cost.
PLANNED = """planned AS (
  SELECT location_name, roster_start_time AS a, roster_end_time AS b, roster_cost AS cost FROM rosters)"""
WORKED = """worked AS (
  SELECT location_name, coalesce(clocked_start_time, pay_start_time) AS a,
         coalesce(clocked_end_time, pay_end_time) AS b, timesheet_cost AS cost FROM timesheets)"""


def hourly(shifts: str, where: str = "true") -> str:
    """Cost per venue and hour label, shift by shift."""
    return f"""SELECT location_name, strftime(slot, '%Y-%m-%d %H:00:00') AS hour, slot, share FROM (
      SELECT location_name, cost::double / greatest(1, date_sub('hour', a, b)) AS share,
             unnest(generate_series(a, greatest(a, b - INTERVAL 1 HOUR), INTERVAL 1 HOUR)) AS slot
      FROM {shifts} WHERE {where})"""


def on_day(day: str) -> str:
    return f"a < DATE '{day}' + INTERVAL 1 DAY AND b >= TIMESTAMP '{day}'"


def within(column: str, start: str, end: str) -> str:
    return f"{column} >= TIMESTAMP '{start}' AND {column} < DATE '{end}' + INTERVAL 1 DAY"


def hourly_compare(clip: str = "true") -> str:
    here = "location_name = 'NATION_2' AND " + on_day("2000-01-17")
    side = "SELECT hour, round(sum(share), 6) AS c FROM ({}) WHERE {} GROUP BY hour"
    return f"""WITH {ROSTERS}, {TIMESHEETS}, {PLANNED}, {WORKED},
      r AS ({side.format(hourly("planned", here), clip)}), t AS ({side.format(hourly("worked", here), clip)})
      SELECT coalesce(r.hour, t.hour) AS hour, coalesce(t.c, 0)::double AS timesheet_wages,
             coalesce(r.c, 0)::double AS roster_wages
      FROM r FULL JOIN t ON r.hour = t.hour"""


def iso_parsed(with_fallback: bool) -> str:
    """Which of the five kinds of text parse, and to what."""
    millis = "WHEN 0 THEN date_trunc('millisecond', ts)" if with_fallback else ""
    parsed = f"CASE event_id % 5 {millis} WHEN 1 THEN date_trunc('second', ts) END"
    return f"""SELECT event_id, CAST({parsed} AS timestamp) AS parsed,
      ({parsed}) IS NULL AS unparsed FROM events"""


VENUE_NAME = "(SELECT min(venue_name) FROM lines WHERE venue_id = 2)"

ROSTER_TEXT = """SELECT location_name, roster_start_time AS Roster_Start_Time,
    CASE WHEN event_id % 97 <> 0 THEN roster_end_time END AS Roster_End_Time,
    CASE WHEN event_id % 83 <> 0 THEN roster_cost::double END AS roster_cost,
    year(roster_start_time) AS year, month(roster_start_time) AS month
  FROM rosters WHERE event_id % 89 <> 0"""

TIMESHEET_TEXT = """SELECT location_name, timesheet_date AS Timesheet_Date,
    timesheet_date + INTERVAL 7 DAY AS Pay_Date, pay_start_time AS Pay_Start_Time,
    pay_end_time AS Pay_End_Time, clocked_start_time AS Clocked_Start_Time,
    clocked_end_time AS Clocked_End_Time, pay_start_time AS Roster_Start_Time,
    pay_end_time AS Roster_End_Time, timesheet_cost::double AS timesheet_cost,
    year(timesheet_date) AS year, month(timesheet_date) AS month
  FROM timesheets"""


def auto_grain(grain: str, start: str, end: str) -> str:
    """Three sums per period, merged by full joins."""
    if grain == "hour":
        here = f"location_name = {VENUE_NAME} AND " + on_day(start)
        w, r = (
            f"""SELECT hour AS p, round(sum(share), 6) AS c FROM ({hourly(side, here)})
            WHERE CAST(slot AS date) = DATE '{start}' GROUP BY hour"""
            for side in ("worked", "planned")
        )
        sold = "strftime(transaction_date, '%Y-%m-%d %H:00:00')"
    else:
        day = "strftime({}, '%Y-%m-%d')" if grain == "day" else f"'{start}..{end}'"
        at = f"location_name = {VENUE_NAME}"
        w = f"""SELECT {day.format('timesheet_date')} AS p, sum(timesheet_cost) AS c FROM timesheets
          WHERE {at} AND {within('timesheet_date', start, end)} GROUP BY 1"""
        r = f"""SELECT {day.format('roster_start_time')} AS p, sum(roster_cost) AS c FROM rosters
          WHERE {at} AND {within('roster_start_time', start, end)} GROUP BY 1"""
        sold = day.format("transaction_date")
    return f"""WITH {ITEMS}, {ROSTERS}, {TIMESHEETS}, {PLANNED}, {WORKED},
      s AS (SELECT {sold} AS p, sum(total_inc) AS c FROM items
            WHERE venue_id = 2 AND {within('transaction_date', start, end)} GROUP BY 1),
      w AS ({w}), r AS ({r}),
      sw AS (SELECT coalesce(s.p, w.p) AS p, s.c AS sc, w.c AS wc FROM s FULL JOIN w ON s.p = w.p)
      SELECT '{grain}' AS grain, coalesce(sw.p, r.p) AS period, coalesce(sc, 0)::double AS sales,
             coalesce(wc, 0)::double AS timesheet_wages, coalesce(r.c, 0)::double AS roster_wages
      FROM sw FULL JOIN r ON sw.p = r.p"""


def _pulls(times: tuple[str, ...]) -> str:
    """Each pull has what was there and lies within nine days of the newest row loaded; too late is what lies two days behind the newest pulled."""
    parts = [
        """seen AS (SELECT *, ts + (CASE WHEN event_id % 97 = 5 THEN 7 WHEN event_id % 10 = 3 THEN 1 ELSE 0 END) * INTERVAL 1 DAY AS seen_at
            FROM events)""",
        f"p0 AS (SELECT *, true AS fits FROM seen WHERE seen_at <= TIMESTAMP '{times[0]}')",
    ]
    for k, at in enumerate(times[1:], 1):
        before = " UNION ALL ".join(f"SELECT ts FROM p{i}" for i in range(k))
        parts.append(f"m{k} AS (SELECT max(ts) AS newest FROM ({before}))")
        parts.append(f"""p{k} AS (SELECT seen.*, ts > newest - INTERVAL 2 DAY AS fits FROM seen, m{k}
            WHERE seen_at <= TIMESTAMP '{at}' AND ts > newest - INTERVAL 9 DAY)""")
    every = " UNION ALL ".join(f"SELECT event_id, event_type, fits FROM p{i}" for i in range(len(times)))
    return f"""WITH {', '.join(parts)}, rows AS (SELECT event_id, event_type, bool_or(fits) AS fits FROM ({every}) GROUP BY 1, 2)
        SELECT event_type, count(*) FILTER (fits) AS loaded, sum(event_id) FILTER (fits)::bigint AS id_sum,
               count(*) FILTER (NOT fits) AS missed FROM rows GROUP BY 1"""


STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
FIRST_FENCED = "split_part(text, '```', 2)"
BODY = f"CASE WHEN contains(text, '```') THEN {FIRST_FENCED} ELSE text END"
LOOSE = STRIP.format(f"replace({BODY}, chr(10), ' ')")
STRICT = STRIP.format(BODY)


def untagged(sql: str) -> str:
    return f"CASE WHEN {sql} LIKE 'sql%' THEN substr({sql}, 4) ELSE {sql} END"


ORACLES: dict[str, str] = {
    "parse_timestamp": iso_parsed(with_fallback=False),
    "parse_timestamp_fallback": iso_parsed(with_fallback=True),
    "regexp_extract_int": """
        SELECT o_orderkey, year(o_orderdate) AS year,
               CASE WHEN o_orderkey % 3 <> 2 THEN month(o_orderdate) ELSE -1 END AS month, day(o_orderdate) AS day
        FROM orders""",
    "struct_field_replace": "SELECT o_orderkey, o_orderdate AS sold FROM orders",
    "cast_concat": """
        SELECT o_orderkey, 'member ' || o_custkey || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS label
        FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01'""",
    "coalesce_times": f"""WITH {TIMESHEETS}, {WORKED}
        SELECT location_name, a AS shift_start, b AS shift_end, cost::double AS cost FROM worked""",
    "hour_bucket": """
        SELECT strftime(ts, '%Y-%m-%d %H:00:00') AS hour, sum(event_id)::bigint AS id_sum
        FROM events GROUP BY 1""",
    "elapsed_hours": f"""WITH {ROSTERS}
        SELECT event_id, date_sub('hour', roster_start_time, roster_end_time) AS elapsed,
               greatest(1, date_sub('hour', roster_start_time, roster_end_time)) AS counted FROM rosters""",
    "hour_slots": f"""WITH {ROSTERS}
        SELECT event_id, unnest(generate_series(roster_start_time,
          greatest(roster_start_time, roster_end_time - INTERVAL 1 HOUR), INTERVAL 1 HOUR)) AS slot
        FROM rosters""",
    "trailing_window": """
        SELECT o_orderkey, o_orderdate, o_orderdate - INTERVAL 3 MONTH AS three_months_before FROM orders
        WHERE o_orderdate BETWEEN TIMESTAMP '1999-12-31 12:00:00' AND TIMESTAMP '2000-03-31 12:00:00'""",
    "last_n_days": """
        SELECT strftime(ts, '%Y-%m-%d') AS date, sum(event_id)::bigint AS id_sum FROM events
        WHERE CAST(ts AS date) BETWEEN DATE '2024-01-11' AND DATE '2024-01-15' GROUP BY 1""",
    "scan_json_partitioned": f"""WITH {LINES}
        SELECT year(landed) AS year, month(landed) AS month, day(landed) AS day, venue_name,
               sum(l_orderkey % 3)::bigint AS sales
        FROM lines GROUP BY ALL""",
    "scan_json_inferred": f"""WITH {ROSTERS}
        SELECT location_name, strftime(roster_start_time, '%Y-%m-%dT%H:%M:%S') AS Roster_Start_Time,
               CASE WHEN event_id % 97 = 0 THEN '' ELSE strftime(roster_end_time, '%Y-%m-%dT%H:%M:%S') END
                 AS Roster_End_Time,
               roster_cost::double AS roster_cost, year(roster_start_time) AS year,
               month(roster_start_time) AS month FROM rosters""",
    "sink_parquet_partitioned": f"""WITH {ROSTERS}
        SELECT event_id, location_name, roster_start_time, roster_end_time, roster_cost::double AS roster_cost,
               year(roster_start_time) AS year, month(roster_start_time) AS month FROM rosters""",
    "egm_extract": f"""WITH {EGM}
        SELECT Venue_Id, strftime(Date, '%Y-%m-%d') AS Date, Time, turnover::double AS Turnover,
               wins::double AS Wins FROM egm""",
    "egm_unread": """
        SELECT unnest(['Venue_Id', 'Date', 'Time', 'EGM Turnover', 'EGM Wins']) AS "column",
               unnest([0, 0, 0, 0, count(*) FILTER (event_id % 79 = 0)]) AS unread
        FROM events WHERE event_type = 'click'""",
    "incremental_ingest": f"WITH {TIMESHEETS} {TIMESHEET_TEXT}",
    "upsert_sales": f"""WITH keyed AS (
          SELECT *, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS landed, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS id
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
        SELECT year(landed) AS year, month(landed) AS month, 1::bigint AS day, c_nationkey AS venue_id, id AS transaction_id,
               c_name || CASE WHEN id % 9 = 0 THEN ' *' ELSE '' END AS member_name,
               CAST(o_totalprice AS {MONEY})::double AS points_balance
        FROM keyed""",
    "pull_overlapping": _pulls(("2024-01-08 00:00:00", "2024-01-09 12:00:00", "2024-01-16 06:00:00", "2024-03-01 00:00:00")),
    "pull_since_mark": """
        SELECT event_type, sum(event_id)::bigint AS id_sum, max(ts) AS next_mark FROM events
        WHERE ts > TIMESTAMP '2024-01-13 20:45:46.150' GROUP BY 1""",
    "etl_sales": f"""WITH {RAW_SALES}
        SELECT * REPLACE (account_balance::double AS account_balance, points_balance::double AS points_balance)
        FROM raw_sales""",
    "etl_sales_inferred": f"""WITH {RAW_SALES}, items AS (
          SELECT year(landed) AS year, month(landed) AS month, venue_id, l_orderkey * 2 AS id, l_linenumber AS line,
                 CASE l_linenumber % 3 WHEN 1 THEN CAST(l_extendedprice AS {MONEY})
                   WHEN 2 THEN CAST(l_extendedprice AS {MONEY}) + CAST(p_retailprice AS {MONEY})
                   ELSE CASE WHEN l_linenumber <> 6 THEN 0 END END AS total
          FROM lines WHERE l_orderkey % 3 > 0
          UNION ALL
          SELECT year(landed), month(landed), venue_id, l_orderkey * 2 + 1, l_linenumber, CAST(p_retailprice AS {MONEY})
          FROM lines WHERE l_orderkey % 3 = 2),
        totals AS (SELECT year, month, venue_id, sum(total) AS total_inc FROM items GROUP BY ALL),
        counted AS (SELECT year, month, venue_id, count(*) AS sales, sum(points_balance) AS points
                    FROM raw_sales GROUP BY ALL)
        SELECT year, month, venue_id, sales, points::double AS points, total_inc::double AS total_inc
        FROM counted JOIN totals USING (year, month, venue_id)""",
    "etl_sales_rest": f"""WITH {RAW_SALES}
        SELECT year, month, venue_id, transaction_id, points_balance::double AS points_balance,
               CASE WHEN venue_id % 3 <> 0 THEN 'R' || venue_id END AS region,
               CASE WHEN transaction_id // 2 % 4 <> 0 THEN 'C' || (transaction_id % 50) END AS clerk,
               (transaction_id % 9)::int AS till, 'S' || (length(first_product) % 4) AS first_size
        FROM raw_sales""",
    "etl_reload_month": f"""WITH {RAW_SALES}
        SELECT year, month, count(*) * CASE WHEN year = 1998 AND month = 6 THEN 2 ELSE 1 END AS sales
        FROM raw_sales GROUP BY year, month""",
    "etl_rosters_audit": f"""WITH {ROSTERS}, read AS (SELECT * FROM rosters WHERE event_id % 89 <> 0)
        SELECT (SELECT count(*) FROM rosters) AS records, (SELECT count(*) FROM rosters WHERE event_id % 89 = 0) AS malformed,
               (SELECT count(*) FROM rosters WHERE event_id % 89 = 0) AS set_aside, count(*) AS rows,
               count(*) FILTER (event_id % 97 = 0) AS unparsed_times,
               count(*) FILTER (event_id % 83 = 0) AS unparsed_values FROM read""",
    "etl_rosters": f"WITH {ROSTERS} {ROSTER_TEXT}",
    "etl_timesheets": f"WITH {TIMESHEETS} {TIMESHEET_TEXT}",
    "explode_sales": f"""WITH {RAW_SALES}
        SELECT venue_name, year, month, sum(transaction_id)::bigint AS id_sum,
               sum(points_balance)::double AS points FROM raw_sales GROUP BY 1, 2, 3""",
    "explode_items": f"""WITH {ITEMS}
        SELECT venue_id, transaction_date, member_id, product_name, quantity::double AS quantity,
               total_inc::double AS total_inc FROM items WHERE master_group_id = 1""",
    "beverage_sales_total": f"""WITH {ITEMS}
        SELECT sum(total_inc)::double AS beverage_sale_inc FROM items
        WHERE venue_id = 1 AND master_group_id = 1
          AND {within("transaction_date", "1996-05-01", "1999-05-17")}""",
    "daily_sales": f"""WITH {ITEMS}
        SELECT venue_id, strftime(transaction_date, '%Y-%m-%d') AS date, sum(total_inc)::double AS sales
        FROM items GROUP BY 1, 2""",
    "daily_wages": f"""WITH {TIMESHEETS}
        SELECT location_name, strftime(timesheet_date, '%Y-%m-%d') AS date, sum(timesheet_cost)::double AS wages
        FROM timesheets GROUP BY 1, 2""",
    "daily_sales_vs_wages": f"""WITH {ITEMS}, {TIMESHEETS},
        s AS (SELECT CAST(transaction_date AS date) AS d, sum(total_inc) AS sales FROM items
              WHERE venue_id = 2 AND {within("transaction_date", "1995-01-01", "2001-12-31")} GROUP BY 1),
        w AS (SELECT CAST(timesheet_date AS date) AS d, sum(timesheet_cost) AS wages FROM timesheets
              WHERE location_name = {VENUE_NAME}
                AND {within("timesheet_date", "1995-01-01", "2001-12-31")} GROUP BY 1)
        SELECT strftime(coalesce(s.d, w.d), '%Y-%m-%d') AS date, coalesce(sales, 0)::double AS sales,
               coalesce(wages, 0)::double AS wages
        FROM s FULL JOIN w ON s.d = w.d""",
    "backward_shifts": f"""WITH {ROSTERS}, {PLANNED}
        SELECT location_name, a AS shift_start, b AS shift_end, cost::double AS cost FROM planned WHERE b < a""",
    "shift_overlap": f"""WITH {TIMESHEETS}, {WORKED}
        SELECT location_name, a AS shift_start, b AS shift_end, cost::double AS cost FROM worked
        WHERE {on_day("2000-01-17")}""",
    "hourly_wages": f"""WITH {TIMESHEETS}, {WORKED}
        SELECT location_name, hour, round(sum(share), 6) AS hourly_cost FROM ({hourly("worked")})
        GROUP BY location_name, hour""",
    "hourly_roster_vs_timesheet": hourly_compare(),
    "hourly_roster_vs_timesheet_clipped": hourly_compare("CAST(slot AS date) = DATE '2000-01-17'"),
    "total_roster_vs_timesheet": f"""WITH {ROSTERS}, {TIMESHEETS}
        SELECT (SELECT coalesce(sum(timesheet_cost), 0) FROM timesheets WHERE location_name = 'NATION_2'
                 AND {within("timesheet_date", "1999-12-01", "2000-05-17")})::double AS timesheet_wages,
               (SELECT coalesce(sum(roster_cost), 0) FROM rosters WHERE location_name = 'NATION_2'
                 AND {within("roster_start_time", "1999-12-01", "2000-05-17")})::double AS roster_wages""",
    "top_products": f"""WITH {ITEMS}
        SELECT product_name, sum(quantity)::double AS total_quantity FROM items
        WHERE master_group_id = 1
          AND transaction_date BETWEEN TIMESTAMP '1999-12-31 12:00:00' AND TIMESTAMP '2000-03-31 12:00:00'
        GROUP BY 1 ORDER BY total_quantity DESC, product_name LIMIT 10""",
    "member_spend": f"""WITH {ITEMS},
        spent AS (SELECT member_id, member_name, sum(total_inc) AS spend FROM items GROUP BY 1, 2),
        sold AS (SELECT o_custkey, sold_at, l_orderkey, c_acctbal, o_totalprice FROM lines
                 WHERE l_linenumber % 3 > 0),
        ranked AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (
                     PARTITION BY o_custkey ORDER BY sold_at DESC, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE l_orderkey END DESC) AS rn FROM sold)
        SELECT member_id, member_name, spend::double AS spend, n AS sales,
               CAST(c_acctbal AS {MONEY})::double AS account_balance,
               CAST(o_totalprice AS {MONEY})::double AS points_balance
        FROM spent JOIN ranked ON member_id = o_custkey AND rn = 1""",
    "venue_dimension": f"""WITH {LINES}, {TIMESHEETS}
        SELECT venue_id, venue_name, sum(timesheet_cost)::double AS wages FROM timesheets
        JOIN (SELECT DISTINCT venue_id, venue_name FROM lines) ON location_name = venue_name
        GROUP BY 1, 2""",
    "auto_grain_total": auto_grain("total", "1999-12-01", "2000-05-17"),
    "auto_grain_day": auto_grain("day", "2000-01-01", "2000-01-31"),
    "auto_grain_hour": auto_grain("hour", "2000-01-17", "2000-01-17"),
    "rollup_ranges": f"""WITH {ITEMS}, {ROSTERS}, {TIMESHEETS},
        asked AS (SELECT k AS range_id, 'NATION_' || (k % 25) AS venue, a, a + k * k // 2 * INTERVAL 1 DAY + (11 * k + 5) * INTERVAL 1 MINUTE AS b
                  FROM (SELECT k, TIMESTAMP '1996-01-01 00:07:00' + 29 * k * INTERVAL 1 DAY + 37 * k * INTERVAL 1 MINUTE AS a FROM range(50) t(k)))
        SELECT range_id,
               (SELECT coalesce(sum(total_inc), 0) FROM items WHERE venue_name = venue AND transaction_date >= a AND transaction_date < b)::double AS sales,
               (SELECT coalesce(sum(timesheet_cost), 0) FROM timesheets WHERE location_name = venue AND timesheet_date >= a AND timesheet_date < b)::double AS timesheet_wages,
               (SELECT coalesce(sum(roster_cost), 0) FROM rosters WHERE location_name = venue AND roster_start_time >= a AND roster_start_time < b)::double AS roster_wages
        FROM asked""",
    "dashboard_daily": f"""WITH {ITEMS}, {ROSTERS}, {TIMESHEETS}, {EGM},
        s AS (SELECT venue_name AS v, CAST(transaction_date AS date) AS d, sum(total_inc) AS c FROM items
              WHERE {within("transaction_date", "1995-01-01", "2001-12-31")} GROUP BY 1, 2),
        t AS (SELECT location_name AS v, CAST(timesheet_date AS date) AS d, sum(timesheet_cost) AS c
              FROM timesheets GROUP BY 1, 2),
        r AS (SELECT location_name AS v, CAST(roster_start_time AS date) AS d, sum(roster_cost) AS c
              FROM rosters GROUP BY 1, 2),
        e AS (SELECT n_name AS v, Date AS d, sum(turnover) AS c, sum(wins) AS c2 FROM egm
              JOIN nation ON n_nationkey = Venue_Id GROUP BY 1, 2),
        st AS (SELECT coalesce(s.v, t.v) AS v, coalesce(s.d, t.d) AS d, s.c AS sales, t.c AS wages
               FROM s FULL JOIN t ON s.v = t.v AND s.d = t.d),
        st_r AS (SELECT coalesce(st.v, r.v) AS v, coalesce(st.d, r.d) AS d, sales, wages, r.c AS planned
                 FROM st FULL JOIN r ON st.v = r.v AND st.d = r.d)
        SELECT coalesce(x.v, e.v) AS venue, strftime(coalesce(x.d, e.d), '%Y-%m-%d') AS date,
               coalesce(sales, 0)::double AS sales, coalesce(wages, 0)::double AS wages,
               coalesce(planned, 0)::double AS roster_cost, coalesce(e.c, 0)::double AS egm_turnover,
               coalesce(e.c2, 0)::double AS egm_wins
        FROM st_r x FULL JOIN e ON x.v = e.v AND x.d = e.d""",
    "compacted_rosters": f"""WITH {ROSTERS}
        SELECT year(roster_start_time) AS year, month(roster_start_time) AS month, count(*) AS shifts, sum(roster_cost)::double AS cost,
               1 AS files, true AS scattered
        FROM rosters GROUP BY 1, 2""",
    "sql_lake_tables": f"""WITH {ROSTERS}, loaded AS ({ROSTER_TEXT}),
        planned AS (SELECT location_name, Roster_Start_Time AS a, Roster_End_Time AS b, roster_cost AS cost
                    FROM loaded WHERE Roster_End_Time IS NOT NULL AND location_name = 'NATION_2')
        SELECT hour, round(sum(share), 6) AS roster_wages FROM ({hourly("planned")}) GROUP BY hour""",
    "extract_sql_reply": f"""WITH {REPLIES}
        SELECT conv_id, turn,
               CASE WHEN text IS NULL OR contains(text, 'NO') THEN 'error' ELSE 'success' END AS status,
               CASE WHEN text IS NULL THEN 'no reply' WHEN contains(text, 'NO') THEN split_part(text, 'NO', 2) ELSE {untagged(LOOSE)} END AS message,
               CASE WHEN text IS NULL OR turn % 5 = 0 THEN 'error' ELSE 'success' END AS strict_status,
               CASE WHEN text IS NULL THEN 'no reply' WHEN turn % 5 = 0 THEN {STRIP.format("substr(text, 3)")}
                    ELSE {STRIP.format(untagged(STRICT))} END AS strict_message
        FROM replies""",
    "flatten_documents": f"WITH {DOCS} SELECT doc_id, source, {flat('text')} AS text FROM docs",
    "document_context": f"""WITH {DOCS}
        SELECT doc_id // 64 AS page, count(*)::int AS docs,
               string_agg({flat('text')}, chr(10) ORDER BY doc_id) AS context
        FROM docs GROUP BY 1""",
    "context_ranges": f"""WITH {DOCS},
        flat AS MATERIALIZED (SELECT doc_id, {flat('text')} || chr(10) AS text FROM docs),
        placed AS MATERIALIZED (
          SELECT doc_id, hex(encode(text)) AS own, (sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text))::bigint AS begin FROM flat),
        pairs AS (SELECT p.doc_id, q.begin AS start, q.own, greatest(p.begin - 1000, 0) AS a, p.begin + 1000 AS b
                  FROM placed p JOIN placed q ON q.begin < p.begin + 1000 AND q.begin + length(q.own) // 2 > greatest(p.begin - 1000, 0)
                  WHERE p.doc_id % 20 = 0),
        cut AS (SELECT doc_id, start, substr(own, 2 * (greatest(a, start) - start) + 1, 2 * (least(b, start + length(own) // 2) - greatest(a, start))) AS part
                FROM pairs)
        SELECT doc_id, string_agg(part, '' ORDER BY start) AS bytes, (sum(length(part)) // 2)::bigint AS n FROM cut GROUP BY doc_id""",
    "whole_file_documents": f"""WITH {DOCS},
        files AS (SELECT doc_id // 64 AS page, string_agg(text, chr(10) ORDER BY doc_id) AS text
                  FROM docs GROUP BY 1)
        SELECT page, {flat('text')} AS value FROM files""",
    "embedding_topk": """
        WITH asked AS (SELECT vec_id AS query_id, embedding::double[] AS e FROM embeddings WHERE vec_id % 20 = 0)
        SELECT query_id, vec_id, round(d, 6) AS distance, rank::int AS rank FROM (
          SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
          FROM asked, embeddings v, LATERAL (SELECT list_distance(e, v.embedding::double[]) AS d))
        WHERE rank <= 10""",
    "embedding_search": """
        WITH asked AS (SELECT vec_id AS query_id, embedding::double[] AS e FROM embeddings WHERE vec_id % 20 = 0)
        SELECT '20240602080000' AS version, query_id, vec_id, round(d, 6) AS distance, rank::int AS rank FROM (
          SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
          FROM asked, embeddings v, LATERAL (SELECT list_distance(e, v.embedding::double[]) AS d))
        WHERE rank <= 3""",
    "embedding_changes": """
        WITH asked AS (SELECT vec_id AS query_id, embedding::double[] AS e FROM embeddings WHERE vec_id % 20 = 0),
        first AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding::double[], lambda x: -x) ELSE embedding::double[] END AS v
                  FROM embeddings WHERE vec_id % 11 <> 0 OR vec_id % 7 = 0),
        second AS (SELECT vec_id, v FROM first WHERE vec_id % 13 <> 0 AND vec_id % 22 <> 0
                   UNION ALL SELECT vec_id, embedding::double[] FROM embeddings WHERE vec_id % 22 = 0)
        SELECT '20240602080000' AS version, query_id, vec_id, round(d, 6) AS distance, rank::int AS rank FROM (
          SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
          FROM asked, second, LATERAL (SELECT list_distance(e, v) AS d))
        WHERE rank <= 3""",
    "embedding_snapshot": """
        SELECT 'text:v1' AS model_id, '20240602080000' AS version, vec_id, label + 100 AS label,
               embedding[1]::double AS first FROM embeddings""",
    "role_gate": f"""WITH {USER_ROLE}
        SELECT event_id, username, role, CASE WHEN role IS NULL THEN 'error'
          WHEN role IN ('analysis', 'admin') THEN 'allowed' ELSE 'Permission Denied' END AS outcome
        FROM requests LEFT JOIN user_role USING (username)""",
    "role_gate_allowed": f"""WITH {USER_ROLE}
        SELECT event_id, username FROM requests JOIN user_role USING (username)
        WHERE role IN ('analysis', 'admin')""",
    "role_gate_refused": f"""WITH {USER_ROLE}
        SELECT event_id, username FROM requests WHERE username NOT IN (
          SELECT username FROM user_role WHERE role IN ('analysis', 'admin'))""",
}
ORACLES["dashboard_upkeep"] = ORACLES["dashboard_daily"]
ORACLES["sql_questions"] = f"""
    SELECT d.date, d.sales - d.wages AS margin, b.beverage_sale_inc, t.roster_wages, p.product_name, p.total_quantity
    FROM ({ORACLES['daily_sales_vs_wages']}) d,
         (WITH {ITEMS} SELECT sum(total_inc)::double AS beverage_sale_inc FROM items
          WHERE venue_id = 2 AND master_group_id = 1 AND {within("transaction_date", "1995-01-01", "2001-12-31")}) b,
         ({ORACLES['total_roster_vs_timesheet']}) t, ({ORACLES['top_products']}) p
    WHERE d.sales > d.wages"""
# A stored index finds what a search of all vectors finds.
ORACLES["index_search"] = ORACLES["embedding_topk"]
ORACLES["index_recall"] = f"SELECT count(*) AS neighbours, true AS enough FROM ({ORACLES['embedding_topk']})"
# Reports asked in SQL return what the reports do.
ORACLES["sql_surface"] = ORACLES["beverage_sales_total"]
for _report in (
    "daily_sales_vs_wages",
    "hourly_roster_vs_timesheet",
    "total_roster_vs_timesheet",
    "top_products",
):
    ORACLES[f"sql_{_report}"] = ORACLES[_report]
ORACLES["auto_grain_report"] = " UNION ALL ".join(
    f"SELECT * FROM ({ORACLES[f'auto_grain_{grain}']})" for grain in ("total", "day", "hour")
)
