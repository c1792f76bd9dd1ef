"""SQL text over registered tables, with errors as messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# What a check and an outcome say.
PASSED = "Passed"
SUCCESS, ERROR = "success", "error"

_PLANNING_FAILED = "Error occurred during query planning"


@dataclass(frozen=True)
class Outcome:
    status: str
    message: str
    frame: DataFrame | None = None


def _query(text: str) -> str:
    """The text without the semicolon it may end in, which a subquery cannot hold."""
    return text.rstrip().removesuffix(";")


def check_sql(spark: SparkSession, text: str, **parameters: object) -> str:
    """``Passed``, or why the text is no query that can be planned. Nothing is executed.

    The text is explained as a subquery, which only a query can be: a command
    fails to parse there, so it is never planned, let alone run. The explanation
    only tells that planning failed; text that got so far is a query, and asking
    for its frame gives the reason without executing it.
    """
    text = _query(text)
    try:
        plan = spark.sql(f"EXPLAIN SELECT * FROM (\n{text}\n)", args=parameters).first()[0]
        if plan.startswith(_PLANNING_FAILED):
            spark.sql(text, args=parameters)
    except PySparkException as error:
        return str(error)
    return PASSED


def run_sql(spark: SparkSession, text: str, **parameters: object) -> Outcome:
    """The result as a frame, not yet executed, or why there is none.

    Values go in as ``:name`` parameters, never by pasting them into the text.
    Anything but a query is refused before Spark sees it as a statement, since
    commands run as soon as they are asked for.
    """
    refused = check_sql(spark, text, **parameters)
    if refused != PASSED:
        return Outcome(ERROR, refused)
    try:
        return Outcome(SUCCESS, text, spark.sql(text, args=parameters))
    except PySparkException as error:
        return Outcome(ERROR, str(error))


def run_sql_into(spark: SparkSession, text: str, path: str, **parameters: object) -> Outcome:
    """Execute once into Parquet at ``path``; run-time errors become the message."""
    planned = run_sql(spark, text, **parameters)
    if planned.frame is None:
        return planned
    try:
        planned.frame.write.mode("errorifexists").parquet(path)
    except PySparkException as error:
        return Outcome(ERROR, str(error))
    return Outcome(SUCCESS, text, spark.read.schema(planned.frame.schema).parquet(path))
