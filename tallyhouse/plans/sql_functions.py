"""The worked questions as table functions, so that other SQL can call and join them.

    SELECT date, sales - wages AS margin
    FROM daily_sales_vs_wages(venue_id => 2, start => '2024-05-01', stop => '2024-06-01')

A call is put into the calling query as if it were written there, so arguments
reach the scans as filters. The functions last as long as the session and read the
views that the worked SQL reads.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from tallyhouse.plans.worked_sql import WORKED_SQL

# What is no text among the parameters.
KINDS = {"venue_id": "INT"}

_PARAMETER = re.compile(r"(?<!:):([a-z_]+)")


def parameters(name: str) -> list[str]:
    """The parameters of a question, in the order of their names."""
    return sorted(set(_PARAMETER.findall(WORKED_SQL[name])))


def register_questions(spark: SparkSession) -> list[str]:
    """Make a temporary table function of every worked question; their names."""
    for name, text in WORKED_SQL.items():
        # Named after the function, a parameter is not taken for a column of the same name.
        body = _PARAMETER.sub(lambda found, name=name: f"{name}.{found[1]}", text)
        taken = ", ".join(f"{p} {KINDS.get(p, 'STRING')}" for p in parameters(name))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({taken}) RETURNS TABLE RETURN {body}")
    return list(WORKED_SQL)
