"""Timestamps and numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text formats and directory patterns of the landed feeds.
WITH_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS"
WITHOUT_MILLIS = "yyyy-MM-dd'T'HH:mm:ss"
PATH_PATTERNS = {
    "year": r"/year=(\d{4})/",
    "month": r"/month=(\d{1,2})/",
    "day": r"/day=(\d{1,2})/",
}


def parse_timestamp(text: Column, *formats: str) -> Column:
    """The first format that fits, else NULL. Bad text never fails the job."""
    parsed = [F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def is_unparsed(text: Column, parsed: Column) -> Column:
    """Text was there but no format fitted it."""
    return text.isNotNull() & parsed.isNull()


def extract_int(text: Column, pattern: str) -> Column:
    """First group of ``pattern`` as an int; NULL where it does not match."""
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def path_level(path: Column, level: str) -> Column:
    """``month=5`` and ``month=05`` in a file path both give 5."""
    return extract_int(path, PATH_PATTERNS[level])
