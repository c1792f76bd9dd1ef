"""The operational questions as Spark SQL with named parameters.

They expect the views ``sales``, ``timesheets`` and ``rosters`` and return what
the reports of the same names return. Range ends are the day after the last day.
"""

from __future__ import annotations

# An unnested item next to the columns of its sale.
_SOLD = """
    SELECT venue_id, venue_name, Sales_Details.Transaction_Date AS at, item.*
    FROM sales LATERAL VIEW explode(Sales_Details.Items) AS item
    WHERE Sales_Details.Transaction_Date >= cast(:start AS timestamp_ntz)
      AND Sales_Details.Transaction_Date < cast(:stop AS timestamp_ntz)"""


def per_hour(table: str, begun: str, ended: str, cost: str, name: str) -> str:
    """Cost of the shifts touching the day, spread over the hours they count."""
    return f"""
    SELECT date_format(slot, 'yyyy-MM-dd HH:00:00') AS hour, round(sum(cost / worked), 6) AS {name}
    FROM (
      SELECT cost, greatest(1, timestampdiff(HOUR, begun, ended)) AS worked,
             explode(sequence(begun, greatest(begun, ended - INTERVAL 1 HOUR), INTERVAL 1 HOUR)) AS slot
      FROM (SELECT {begun} AS begun, {ended} AS ended, {cost} AS cost, location_name FROM {table})
      WHERE location_name = :location
        AND begun < cast(:stop AS timestamp_ntz) AND ended >= cast(:start AS timestamp_ntz))
    GROUP BY ALL"""


WORKED_SQL = {
    "beverage_sales_total": f"""
        SELECT sum(Total_Inc) AS beverage_sale_inc FROM ({_SOLD})
        WHERE venue_id = :venue_id AND Master_Group_Id = 1""",
    "daily_sales_vs_wages": f"""
        SELECT date, coalesce(sales, 0) AS sales, coalesce(wages, 0) AS wages
        FROM (SELECT to_date(at) AS date, sum(Total_Inc) AS sales FROM ({_SOLD})
              WHERE venue_id = :venue_id GROUP BY ALL)
        FULL JOIN
             (SELECT to_date(timesheet_date) AS date, sum(timesheet_cost) AS wages FROM timesheets
              JOIN (SELECT min(venue_name) AS named FROM sales WHERE venue_id = :venue_id) ON location_name = named
              WHERE timesheet_date >= cast(:start AS timestamp_ntz)
                AND timesheet_date < cast(:stop AS timestamp_ntz)
              GROUP BY ALL)
        USING (date) ORDER BY date""",
    "hourly_roster_vs_timesheet": f"""
        SELECT hour, coalesce(timesheet_wages, 0) AS timesheet_wages,
               coalesce(roster_wages, 0) AS roster_wages
        FROM ({per_hour("rosters", "roster_start_time", "roster_end_time", "roster_cost", "roster_wages")})
        FULL JOIN ({per_hour(
            "timesheets",
            "coalesce(clocked_start_time, pay_start_time)",
            "coalesce(clocked_end_time, pay_end_time)",
            "timesheet_cost",
            "timesheet_wages",
        )})
        USING (hour) ORDER BY hour""",
    "total_roster_vs_timesheet": """
        SELECT coalesce(sum(cost) FILTER (WHERE feed = 'timesheets'), 0) AS timesheet_wages,
               coalesce(sum(cost) FILTER (WHERE feed = 'rosters'), 0) AS roster_wages
        FROM (SELECT 'timesheets' AS feed, location_name, timesheet_date AS at, timesheet_cost AS cost
              FROM timesheets
              UNION ALL
              SELECT 'rosters', location_name, roster_start_time, roster_cost FROM rosters)
        WHERE location_name = :location
          AND at >= cast(:start AS timestamp_ntz) AND at < cast(:stop AS timestamp_ntz)""",
    "top_products": """
        SELECT item.Product_Name AS product_name, sum(item.Quantity) AS total_quantity
        FROM sales LATERAL VIEW explode(Sales_Details.Items) AS item
        WHERE item.Master_Group_Id = 1
          AND Sales_Details.Transaction_Date <= cast(:as_of AS timestamp_ntz)
          AND Sales_Details.Transaction_Date >= cast(:as_of AS timestamp_ntz) - INTERVAL 3 MONTHS
        GROUP BY ALL ORDER BY total_quantity DESC, product_name LIMIT 10""",
}
