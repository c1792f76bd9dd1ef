"""Loading only what is new: by file with a checkpoint, or by a time mark."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Moment, as_moment, moment
from tallyhouse.plans.etl import Job, malformed, malformed_path, table_schema
from tallyhouse.schemas import MALFORMED
from tallyhouse.sources.landing import ANY_AGE, LANDED, stream_landing
from tallyhouse.sources.tables import BATCH, log_line, log_lines, own_by_stream, write_table

# Fixed value: how a stored mark is written.
MARK_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSX"

# A backlog is taken in steps of this many files, each committed on its own.
FILES_PER_BATCH = 10_000

# What the commit log of an upserted table says of a batch.
STAGED, DONE = "staged", "done"


def _each_batch(stream: DataFrame, checkpoint: str, load: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _counted(raw: DataFrame) -> tuple[DataFrame, Observation]:
    """Records whose broken lines are counted along with the pass that first reads them."""
    seen = Observation()
    return raw.observe(seen, F.count(MALFORMED).alias("malformed")), seen


def _set_aside(raw: DataFrame, seen: Observation, job: Job, out: str, batch: int) -> None:
    """The lines of a batch that are no records, in directories of its own; read again only if there are any."""
    raw = raw if seen.get["malformed"] else raw.limit(0)
    lines = malformed(raw, job.feed).withColumn(BATCH, F.lit(batch))
    write_table(lines, malformed_path(out), [*job.feed.partitions, BATCH], "replace_partitions", regroup=False)


def ingest_new_files(
    spark: SparkSession,
    job: Job,
    landing: str,
    out: str,
    checkpoint: str,
    files_per_batch: int = FILES_PER_BATCH,
    archive: str | None = None,
) -> None:
    """Load every landed file not loaded yet, whatever its age, then stop.

    One stream writes rows and the lines that are no records, so both come from the
    same files, also when ``archive`` names a folder that loaded files move to. A
    batch has directories of its own below those of the levels and replaces them
    when it is repeated, so a run that dies half way adds each row once. Schedule
    it as often as wanted; use one checkpoint and output per feed. The output
    belongs to the stream, and batch jobs refuse to write there.
    """
    own_by_stream(spark, out, checkpoint)

    def load(raw: DataFrame, batch: int) -> None:
        counted, seen = _counted(raw)
        rows = job.transform(counted.drop(LANDED)).withColumn(BATCH, F.lit(batch))
        write_table(rows, out, [*job.feed.partitions, BATCH], "replace_partitions", regroup=False)
        _set_aside(raw, seen, job, out, batch)

    _each_batch(stream_landing(spark, landing, job.feed, files_per_batch, archive), checkpoint, load)


def upsert_new_files(
    spark: SparkSession,
    job: Job,
    key: str,
    landing: str,
    out: str,
    checkpoint: str,
    files_per_batch: int = FILES_PER_BATCH,
    archive: str | None = None,
) -> None:
    """Load every landed file not loaded yet; a record sent again replaces the older one.

    ``key``, a column or field of the job's table, tells records apart; a row
    without one is only ever added. Of several in one batch the one whose file is
    newest counts, of one file any. A record stays in the directory it first came
    to, and only directories with new or replaced rows are written again.

    A batch writes the new contents of these directories beside the table first and
    notes that; then it puts them in place and notes that too. A batch that is
    repeated goes on from what it has noted, so it changes nothing that it has
    done, however far it came. Finding older rows reads the key column of the table.
    The records of a batch are parsed once, and stored as typed rows for the rest.
    """
    log, staging = f"{checkpoint.rstrip('/')}-commits", f"{checkpoint.rstrip('/')}-staged"
    schema = table_schema(spark, job, rest=True)
    levels = job.feed.partitions
    own_by_stream(spark, out, checkpoint)
    write_table(spark.createDataFrame([], schema), out, levels, regroup=False)  # so that there is a table

    def load(raw: DataFrame, batch: int) -> None:
        spark = raw.sparkSession
        states = log_lines(spark, log, str(batch))
        staged = f"{staging}/batch={batch}"
        if DONE in states:
            return
        if STAGED not in states:
            counted, seen = _counted(raw)
            typed, parsed = job.transform(counted), f"{staging}/rows-of-batch={batch}"
            typed.write.mode("overwrite").parquet(parsed)
            merged = _merged(spark.read.schema(schema).parquet(out), spark.read.schema(typed.schema).parquet(parsed), key, levels)
            merged.select([f.name for f in schema]).write.mode("overwrite").partitionBy(*levels).parquet(staged)
            _set_aside(raw, seen, job, out, batch)
            log_line(spark, log, str(batch), STAGED)
        write_table(spark.read.schema(schema).parquet(staged), out, levels, "replace_partitions", regroup=False)
        log_line(spark, log, str(batch), DONE)

    _each_batch(stream_landing(spark, landing, job.feed, files_per_batch, archive), checkpoint, load)


def _merged(table: DataFrame, rows: DataFrame, key: str, levels: tuple[str, ...]) -> DataFrame:
    """All rows of the directories that the new rows touch, as they are to be."""
    own: Column = F.col(key)
    rows = rows.withColumn("_key", own)
    columns = [c for c in rows.columns if c not in (LANDED, "_key")]
    nameless = rows.where("_key IS NULL").select(columns)
    whole = F.struct(*[F.col(c) for c in columns])
    latest = rows.where("_key IS NOT NULL").groupBy("_key").agg(F.max_by(whole, LANDED).alias("row"))
    place = F.struct(*levels)
    known = table.where(own.isNotNull()).select(own.alias("_key"), place.alias("_place"))
    first = known.join(latest.select("_key"), "_key").groupBy("_key").agg(F.min("_place").alias("_first"))
    placed = latest.join(first, "_key", "left").select("_key", "row", F.coalesce("_first", F.struct(*[F.col(f"row.{c}").alias(c) for c in levels])).alias("_first"))
    fresh = placed.select(*[(F.col(f"_first.{c}") if c in levels else F.col(f"row.{c}")).alias(c) for c in columns]).unionByName(nameless)
    every = known.join(latest.select("_key"), "_key").select("_place.*").union(fresh.select(*levels))
    touched = every.distinct()
    old = table.join(touched, list(levels), "left_semi").withColumn("_key", own)
    stays = old.join(latest.select("_key"), "_key", "left_anti")  # a null key is equal to none, so it stays
    return stays.select(columns).unionByName(fresh)


def rows_since(df: DataFrame, ts: str, mark: Moment | None) -> DataFrame:
    """Rows later than the last run's mark; all of them on the first run."""
    return df if mark is None else df.where(F.col(ts) > moment(mark))


def next_mark(df: DataFrame, ts: str) -> DataFrame:
    """A single row with the mark to store after loading ``df``.

    A row that appears late, with a time before the mark, is not in the next pull;
    where that can happen use ``overlapping`` pulls, or load by file.
    """
    return df.agg(F.max(ts).alias("mark"))


def read_mark(spark: SparkSession, path: str) -> DataFrame:
    """The latest stored mark, NULL if none of the text is one."""
    parsed = F.try_to_timestamp(F.trim("value"), F.lit(MARK_FORMAT)).cast("timestamp_ntz")
    return spark.read.text(path).agg(F.max(parsed).alias("mark"))


def write_mark(mark: DataFrame, path: str) -> None:
    """Add a mark; earlier ones stay, so a failed write never loses the last."""
    text = F.concat(F.date_format("mark", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("Z"))
    mark.where("mark IS NOT NULL").select(text.alias("value")).write.mode("append").text(path)


def overlapping(df: DataFrame, ts: str, mark: Moment | None, reach: timedelta) -> DataFrame:
    """Rows since ``reach`` before the last run's mark: late ones, and others that were pulled before."""
    return df if mark is None else df.where(F.col(ts) > moment(as_moment(mark) - reach))


def ingest_pulls(
    spark: SparkSession, pulls: str, schema: str, key: str, ts: str, overlap: timedelta, out: str, checkpoint: str
) -> None:
    """Add the rows of landed pulls to a table, each once, then stop.

    Pulls overlap, so a row comes as often as it lies within their reach. Its key is
    remembered in the stream's state until the newest time seen is more than
    ``overlap`` past its own; by then a row of that time counts as too late, whether
    it was loaded or not. So state holds the keys of one overlap, however long the
    table is. Let pulls reach back at least as far as the overlap; what they bring
    that is older and was not loaded is in ``missed_rows``.
    """
    rows = spark.readStream.schema(schema).option("maxFileAge", ANY_AGE).parquet(pulls)
    late = f"{int(overlap.total_seconds() * 1000)} milliseconds"
    # A watermark needs an instant; the zone of the session is that of the rows' clock.
    timed = rows.withColumn("_instant", F.col(ts).cast("timestamp_ltz")).withWatermark("_instant", late)
    once = timed.dropDuplicatesWithinWatermark([key]).drop("_instant")
    query = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def missed_rows(pulled: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Rows that pulls have brought too late to be loaded, each once."""
    return pulled.join(loaded.select(key), key, "left_anti").dropDuplicates([key])
