"""Lake tables: partitioned Parquet, CSV exports and catalog entries."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import shuffles_removed


def rebalanced(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Group rows by output directory before a write.

    Without it every task opens a file in every directory. Rebalancing lets
    adaptive execution merge small directories into one task and split one that
    holds a large share of the rows over many.
    """
    return df.hint("rebalance", *[F.col(c) for c in partition_by])


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    mode: str = "append",
    regroup: bool = True,
    max_records_per_file: int = 0,
) -> None:
    """Snappy Parquet in ``key=value`` directories.

    ``append`` adds the rows, so running it twice doubles them.
    ``replace_partitions`` replaces exactly the directories present in ``df``
    and can be repeated; use it only when ``df`` holds all rows of those.
    ``regroup`` off saves the shuffle where the input is laid out like the
    output already, as a landing is.
    """
    writer = (
        (rebalanced(df, partition_by) if regroup else df)
        .write.partitionBy(*partition_by)
        .option("compression", "snappy")
        .option("maxRecordsPerFile", max_records_per_file)
    )
    if mode == "append":
        writer = writer.mode("append")
    elif mode == "replace_partitions":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        raise ValueError(f"unknown write mode {mode!r}")
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)


# The innermost level of a table that a stream adds to: the number of its batch.
BATCH = "batch"
_LINE = "key string, value string"


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def log_line(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Note something; earlier notes stay."""
    spark.createDataFrame([(key, value)], _LINE).coalesce(1).write.mode("append").parquet(path)


def log_lines(spark: SparkSession, path: str, key: str) -> set[str]:
    """All that was noted under a key."""
    if not _there(spark, path):
        return set()
    return {r["value"] for r in spark.read.schema(_LINE).parquet(path).where(F.col("key") == key).collect()}


def own_by_stream(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Note which checkpoint a table belongs to; another one could not know what is in it."""
    owner = f"{path.rstrip('/')}/_owner"
    if _there(spark, f"{path.rstrip('/')}/_spark_metadata"):
        raise ValueError(f"{path} has the log of a file sink, which would hide what is added; use another output")
    owners = log_lines(spark, owner, "checkpoint")
    if not owners:
        log_line(spark, owner, "checkpoint", checkpoint)
    elif owners != {checkpoint}:
        raise ValueError(f"{path} is written by a stream with another checkpoint")


def owned_by_stream(spark: SparkSession, path: str) -> bool:
    return any(_there(spark, f"{path.rstrip('/')}/{log}") for log in ("_owner", "_spark_metadata"))


def _listed(spark: SparkSession, path: str, partition_by: Sequence[str], condition: str | None) -> DataFrame | None:
    """A row per file with its levels as numbers, of the directories that meet a condition; nothing is opened.

    Spark lists the directories in parallel and the rows stay in the tasks. None if
    there is no directory of all levels.
    """
    if not _there(spark, path):
        return None
    files = spark.read.format("binaryFile").load(path)
    if not set(partition_by) <= set(files.columns):
        return None
    files = files.select(*[F.col(c).try_cast("int").alias(c) for c in partition_by], "path")
    return files if condition is None else files.where(condition)


def directory_marks(
    spark: SparkSession, path: str, partition_by: Sequence[str], condition: str | None = None
) -> dict[tuple[int, ...], tuple[int, int]]:
    """What tells the files of a directory apart from others, a number or two for each directory."""
    files = _listed(spark, path, partition_by, condition)
    if files is None:
        return {}
    marks = files.where(F.col("path").endswith(".parquet")).groupBy(*partition_by).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path")))
    return {tuple(r[:-2]): tuple(r[-2:]) for r in marks.collect()}


def clear_levels(
    spark: SparkSession, landing: str, out: str, partition_by: Sequence[str],
    before: Mapping[tuple[int, ...], tuple[int, int]], condition: str | None = None,
) -> int:
    """Remove the table's directories that were to be replaced and got no rows.

    A replaced directory has new files; one whose files are those of before,
    though its landing directory was among those read, has lost all its rows.
    """
    read = _listed(spark, landing, partition_by, condition)
    if read is None or not before:
        return 0
    after = directory_marks(spark, out, partition_by, condition)
    same = {x for x, mark in after.items() if before.get(x) == mark}
    if not same:
        return 0
    kind = ", ".join(f"{c} int" for c in partition_by)
    cleared = read.select(*partition_by).distinct().join(spark.createDataFrame(sorted(same), kind), list(partition_by), "left_semi")
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    gone = _listed(spark, out, partition_by, condition).join(F.broadcast(cleared), list(partition_by), "left_semi").select(folder, *partition_by)
    folders = gone.distinct().collect()  # a row for each directory that goes
    for row in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(row["folder"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len({tuple(r[1:]) for r in folders})


def compact_table(spark: SparkSession, path: str, out: str, partition_by: Sequence[str]) -> None:
    """Rewrite a table of many small files into few, beside the original."""
    write_table(spark.read.parquet(path), out, partition_by, mode="replace_partitions")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Let SQL text name the frames."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_lake(
    spark: SparkSession, database: str, location: str, tables: Mapping[str, str]
) -> None:
    """Put Parquet directories under ``database`` as external tables.

    A table that is there already is only brought up to date, so its readers meet
    no gap; one that points elsewhere is put in anew.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION {_quoted(location)}")
    for name, path in tables.items():
        table = f"`{database}`.`{name}`"
        if spark.catalog.tableExists(table) and _location(spark, table) != path.removeprefix("file:").rstrip("/"):
            spark.sql(f"DROP TABLE {table}")
        if not spark.catalog.tableExists(table):
            spark.sql(f"CREATE TABLE {table} USING parquet LOCATION {_quoted(path)}")
        if any(column.isPartition for column in spark.catalog.listColumns(table)):
            spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
        spark.catalog.refreshTable(table)


def _location(spark: SparkSession, table: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()
    return described["data_type"].removeprefix("file:").rstrip("/")


# What a compaction aims at, and below half of which a file is small.
FILE_BYTES = 128 << 20


def directory_files(table: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """A row per directory of a table that rows were found in: its files, its bytes and how many of its files are small.

    The tasks that read a file tell its size, without reading a column, so nobody
    lists the table beyond what a scan of it needs.
    """
    files = table.select(*partition_by, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    sizes = files.groupBy(*partition_by, "file").agg(F.max("bytes").alias("bytes"))
    return sizes.groupBy(*partition_by).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.count_if(F.col("bytes") < F.lit(FILE_BYTES // 2)).alias("small"),
    )


def compact_lake(spark: SparkSession, table: str, location: str, at_least: int = 2) -> int:
    """Merge the files of those directories of a catalog table that have ``at_least`` small ones; how many directories that were.

    Their rows are written to directories of their own below ``location``; then the
    catalog points each partition there. Until that moment readers find the old
    files, after it the new ones with the same rows, and a reader that is under way
    keeps the old ones, which stay. A run that dies before it is done leaves files
    that nothing points to. Directories without small files are not touched.
    """
    levels = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    frame = spark.table(table)
    found = directory_files(frame, levels).where(F.col("small") >= at_least).select(levels)
    chosen = [tuple(r) for r in found.collect()]  # a row for each directory that will be moved
    if not chosen:
        return 0
    path = f"{location.rstrip('/')}/compaction={uuid.uuid4().hex}"
    wanted = F.broadcast(spark.createDataFrame(chosen, T.StructType([frame.schema[c] for c in levels])))
    write_table(frame.join(wanted, levels, "left_semi").select(frame.columns), path, levels, regroup=True)
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
    for *values, folder in spark.read.schema(frame.schema).parquet(path).select(*levels, folder).distinct().collect():
        spec = ", ".join(f"`{c}` = {_literal(v)}" for c, v in zip(levels, values, strict=True))
        spark.sql(f"ALTER TABLE {table} PARTITION ({spec}) SET LOCATION {_quoted(unquote(folder))}")
    spark.catalog.refreshTable(table)
    return len(chosen)


def _literal(value: object) -> str:
    return _quoted(value) if isinstance(value, str) else str(value)
