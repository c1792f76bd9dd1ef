"""The daily dashboard as a stored table that only changes where its feeds have.

Every directory of a feed has a mark: how many files it has, how large and how new
they are. A refresh compares the marks with those it kept the last time, reads which
days lie in the directories that have changed, and sums these days again. Days of
directories that are gone count too, as their days were kept with their marks.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.plans.dashboard import MEASURES, dashboard_daily
from tallyhouse.sources.tables import write_table

STATE = "feed string, directory string, mark string, days array<date>"
POINTER = "number int, path string"
TABLE = "venue string, " + ", ".join(f"{m} decimal(38,2)" for m in MEASURES) + ", nothing boolean, date date"


class Source(NamedTuple):
    """A feed as it is stored: its directories, and the day a row counts for."""

    frame: DataFrame
    levels: Sequence[str]
    day: Column


def _marks(name: str, source: Source) -> DataFrame:
    """A row per directory; no column of the feed is read for it."""
    directory = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in source.levels])
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_modification_time")]
    files = source.frame.select(directory.alias("directory"), *meta).groupBy("directory", "file_path")
    each = files.agg(F.max("file_size").alias("size"), F.max("file_modification_time").alias("newest"))
    mark = F.concat_ws(" ", F.count(F.lit(1)), F.sum("size"), F.unix_micros(F.max(F.col("newest").cast("timestamp_ltz"))))
    return each.groupBy("directory").agg(mark.alias("mark")).select(F.lit(name).alias("feed"), "directory", "mark")


def _days(name: str, source: Source, changed: DataFrame) -> DataFrame:
    """The days in some directories of a feed."""
    directory = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in source.levels])
    own = changed.where(F.col("feed") == name).select("directory")
    rows = source.frame.select(directory.alias("directory"), source.day.alias("day")).join(F.broadcast(own), "directory", "left_semi")
    return rows.groupBy("directory").agg(F.collect_set("day").alias("days")).select(F.lit(name).alias("feed"), "directory", "days")


def _latest(spark: SparkSession, state: str) -> tuple[int, DataFrame]:
    try:
        last = spark.read.schema(POINTER).parquet(f"{state}/pointer").orderBy(F.desc("number")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        return 0, spark.createDataFrame([], STATE)
    return last["number"], spark.read.schema(STATE).parquet(last["path"])


def refresh_dashboard(spark: SparkSession, sources: Mapping[str, Source], venues: DataFrame, out: str, state: str) -> list[date]:
    """Bring the stored dashboard up to date; the days that were summed again.

    ``sources`` has items, timesheets, rosters and egm. The table has a directory per
    day, and only those of touched days are replaced. The marks are kept after that,
    so a run that dies before sums the same days again. The driver gets the touched
    days, each once.
    """
    number, kept = _latest(spark, state)
    now = reduce(DataFrame.unionByName, [_marks(name, s) for name, s in sources.items()])
    folder = f"{state}/marks={uuid.uuid4().hex}"
    now.write.parquet(f"{folder}-now")
    now = spark.read.schema("feed string, directory string, mark string").parquet(f"{folder}-now")
    key = ["feed", "directory"]
    same = now.join(kept, [*key, "mark"], "inner").select(*key, "mark", "days")
    changed = now.join(same, key, "left_anti")
    days = reduce(DataFrame.unionByName, [_days(name, s, changed) for name, s in sources.items()])
    fresh = changed.join(days, key, "left").select(*key, "mark", F.coalesce("days", F.array().cast("array<date>")).alias("days"))
    same.unionByName(fresh).write.parquet(folder)
    marks = spark.read.schema(STATE).parquet(folder)
    gone = kept.join(same, key, "left_anti")
    touched = marks.join(same, key, "left_anti").select("days").unionByName(gone.select("days"))
    found = sorted(r["day"] for r in touched.select(F.explode("days").alias("day")).where("day IS NOT NULL").distinct().collect())
    if found:
        write_table(_summed(spark, sources, venues, found), out, ["date"], "replace_partitions")
    spark.createDataFrame([(number + 1, folder)], POINTER).coalesce(1).write.mode("append").parquet(f"{state}/pointer")
    return found


def _summed(spark: SparkSession, sources: Mapping[str, Source], venues: DataFrame, days: list[date]) -> DataFrame:
    """The dashboard of some days; one on which nothing is left has a row that says so, as its directory must be replaced too."""
    frames = {name: s.frame.where(s.day.isin(days)) for name, s in sources.items()}
    rows = dashboard_daily(
        frames["items"], frames["timesheets"], frames["rosters"], frames["egm"], days[0], days[-1], venues=venues
    )
    rows = rows.select("venue", *[F.col(m).cast("decimal(38,2)").alias(m) for m in MEASURES], F.lit(False).alias("nothing"), "date")
    every = spark.createDataFrame([(d,) for d in days], "date date")
    empty = every.join(rows.select("date").distinct(), "date", "left_anti")
    none = [F.lit(0).cast("decimal(38,2)").alias(m) for m in MEASURES]
    return rows.unionByName(empty.select(F.lit(None).cast("string").alias("venue"), *none, F.lit(True).alias("nothing"), "date"))


def read_dashboard(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(out).where(~F.col("nothing")).select("venue", "date", *MEASURES)
