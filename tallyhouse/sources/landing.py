"""Scans of landed JSON, CSV and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.conform import landed_type
from tallyhouse.functions.rest import FIELDS, REST, rest_of, with_rest
from tallyhouse.functions.timeparse import path_level
from tallyhouse.schemas import MALFORMED, Feed


def read_landing(spark: SparkSession, root: str, feed: Feed, infer: bool = False) -> DataFrame:
    """Landed JSON below ``root`` with the directory levels as int columns.

    Levels come from partition discovery rather than from a pattern over the
    file name: the values are the same and a filter on them skips directories.
    Reading the root instead of a glob makes an empty landing an empty table.
    ``infer`` takes the record schema from the files, at the price of a pass
    over all of them, and so keeps fields that the feed does not name. A line
    that is no record is kept in a column of its own either way.
    """
    reader = spark.read.option("basePath", root).option("columnNameOfCorruptRecord", MALFORMED)
    if not infer:
        return reader.schema(feed.schema).json(root)
    found = reader.json(root).schema
    if MALFORMED not in found.names:
        found = T.StructType([*found, T.StructField(MALFORMED, T.StringType())])
    inferred = reader.schema(found).json(root)
    levels = [F.col(c).cast("int").alias(c) for c in feed.partitions]
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in feed.record if f.name not in found.names]
    rest = [c for c in inferred.columns if c not in feed.partitions]
    return inferred.select(*rest, *missing, *levels)


def read_whole(spark: SparkSession, root: str, feed: Feed) -> DataFrame:
    """Landed records with everything they hold: declared fields as declared, the others in ``rest``.

    Lines are read as text and parsed by the schema and as a VARIANT, which needs
    no pass over the files to find out what else there is. Levels are those of
    partition discovery, so a filter on them skips directories.
    """
    lines = spark.read.option("basePath", root).text(root)
    levels = [(F.col(c) if c in lines.columns else F.lit(None)).cast("int").alias(c) for c in feed.partitions]
    return whole_records(lines.select("value", *levels), feed)


def whole_records(lines: DataFrame, feed: Feed, *carried: str) -> DataFrame:
    """Records out of lines (``value``, the levels, and columns that are carried along).

    A line may hold an array of records. One that is no record, or not readable
    as a VARIANT, is kept as it is under ``MALFORMED``; empty lines are none.
    """
    value = F.col("value")
    elements = F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda x: F.to_json(x))
    several = F.coalesce(F.when(F.ltrim(value).startswith("["), elements), F.array(value))
    single = lines.where(F.trim(value) != "").select(F.explode(several).alias("value"), *feed.partitions, *carried)
    kind = T.StructType([*landed_type(feed.record).fields, T.StructField(MALFORMED, T.StringType())])
    record = F.from_json(value, kind, {"columnNameOfCorruptRecord": MALFORMED})
    parsed = single.select("value", record.alias("record"), F.try_parse_json(value).alias("whole"), *feed.partitions, *carried)
    parsed = parsed.withColumn("fields", F.try_variant_get("whole", "$", FIELDS))
    whole, names = F.col("whole"), [f.name for f in feed.record]
    fields = [
        with_rest(F.col("record")[f.name], F.try_element_at("fields", F.lit(f.name)), landed_type(f.dataType)).alias(f.name)
        for f in feed.record
    ]
    broken = F.when(whole.isNull(), value).otherwise(F.col("record")[MALFORMED]).alias(MALFORMED)
    return parsed.select(*fields, broken, rest_of(F.col("fields"), names).alias(REST), *feed.partitions, *carried)


# When the file of a streamed record was written.
LANDED = "_landed"

# Longer than any file has been lying there.
ANY_AGE = "36500d"


def stream_landing(spark: SparkSession, root: str, feed: Feed, files_per_batch: int, archive: str | None = None) -> DataFrame:
    """The same records as a stream that picks up each file once, however old it is.

    By default a file source passes over files a week older than the newest it
    has seen; a vendor sending last month again would lose them. With ``archive``
    loaded files are moved there, which keeps the listing short. Levels come from
    the path of each file, as a stream may begin before there is any directory;
    ``LANDED`` has the time of the file.
    """
    reader = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", ANY_AGE)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    path = F.col("_metadata.file_path")
    levels = [path_level(path, c).alias(c) for c in feed.partitions]
    return whole_records(reader.text(root).select("value", *levels, F.col("_metadata.file_modification_time").alias(LANDED)), feed, LANDED)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, its whole text in ``value``."""
    return spark.read.text(path, wholetext=True)


# The columns kept from a gaming-machine reading and the new name.
EGM_COLUMNS = {
    "Venue": T.IntegerType(),
    "Date": T.DateType(),
    "Time": T.StringType(),
    "EGM Turnover": T.DecimalType(14, 2),
    "EGM Wins": T.DecimalType(14, 2),
}
EGM_DATES = ("yyyy-MM-dd", "dd/MM/yyyy")
EGM_RENAMES = {"Venue": "Venue_Id"}


def read_egm_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gaming-machine readings by column name, whatever else a file holds.

    All values are text, exactly as written; ``typed_egm`` types them later.
    ``enforceSchema`` is off, so a file whose header is ordered differently fails
    instead of being read by position.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*[F.col(f"`{name}`") for name in EGM_COLUMNS])


def extract_egm(readings: DataFrame) -> DataFrame:
    return readings.select(*EGM_COLUMNS).withColumnsRenamed(EGM_RENAMES)


def typed_egm(extracted: DataFrame) -> DataFrame:
    """Readings with their types: dates in either form, amounts with commas between thousands."""
    return extracted.select(
        *[_typed(EGM_RENAMES.get(name, name), kind).alias(EGM_RENAMES.get(name, name)) for name, kind in EGM_COLUMNS.items()]
    )


def unread_egm(extracted: DataFrame) -> DataFrame:
    """A row per column: how many of its texts ``typed_egm`` cannot read."""
    names = [EGM_RENAMES.get(name, name) for name in EGM_COLUMNS]
    lost = [
        F.count_if(F.col(f"`{name}`").isNotNull() & _typed(name, kind).isNull()).alias(name)
        for name, kind in zip(names, EGM_COLUMNS.values(), strict=True)
    ]
    return extracted.agg(*lost).unpivot([], [F.col(f"`{n}`") for n in names], "column", "unread")


def _typed(name: str, kind: T.DataType) -> Column:
    text = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, T.DateType):
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(form)).cast("date") for form in EGM_DATES])
    if isinstance(kind, T.DecimalType):
        grouped = text.rlike(r"^[-+]?\d{1,3}(,\d{3})+(\.\d*)?$")
        text = F.when(grouped, F.replace(text, F.lit(","))).otherwise(text)
    return text.try_cast(kind)

