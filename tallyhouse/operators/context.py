"""Flattened documents as context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.text import flatten_text
from tallyhouse.operators.ordering import running
from tallyhouse.sources.landing import read_documents
from tallyhouse.sources.tables import write_table

PAGE_DOCS = 64


def flatten_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, flatten_text(F.col(text)))


def _numbered(docs: DataFrame, text: Column) -> DataFrame:
    """Documents in order of their ids, rows of one id by the hash of their texts: text, row number and bytes before, line feeds among them."""
    entries = docs.select("doc_id", text.alias("text"))
    return running(entries, ["doc_id", F.xxhash64("text")], F.octet_length("text") + 1)


def _pages(docs: DataFrame, text: Column, page_docs: int) -> DataFrame:
    """``page`` and its entries in order; a page has at most ``page_docs`` rows, however many share an id."""
    numbered = _numbered(docs.where("text IS NOT NULL"), text)
    entry = F.struct("row", "text")
    pages = numbered.groupBy(F.floor(F.col("row") / page_docs).cast("bigint").alias("page")).agg(F.collect_list(entry).alias("entries"))
    return pages.select("page", F.transform(F.array_sort("entries"), lambda e: e["text"]).alias("entries"))


def context_pages(docs: DataFrame, page_docs: int = PAGE_DOCS) -> DataFrame:
    """The joined context, cut into pages of ``page_docs`` documents in order of their ids.

    Pages in order, joined by a line feed, are the context of all documents. They
    are cut by a running row number, so none grows with the data. Documents without
    a text have no place in it.
    """
    pages = _pages(docs, flatten_text(F.col("text")), page_docs)
    return pages.select("page", F.size("entries").alias("docs"), F.array_join("entries", "\n").alias("context"))


def write_pages(docs: DataFrame, path: str, page_docs: int = PAGE_DOCS) -> None:
    """Pages of documents as they are, a file each, all in one directory.

    The first line of a file is its page. A directory per page would leave as
    many for the driver to list as there are pages.
    """
    pages = _pages(docs, F.col("text"), page_docs)
    lines = F.concat(F.array(F.col("page").cast("string")), F.col("entries"))
    pages.select(F.array_join(lines, "\n")).write.option("maxRecordsPerFile", 1).text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page`` and its text in ``value``, from files that ``write_pages`` wrote."""
    files, end = read_documents(spark, path), F.locate("\n", F.col("value"))
    return files.select(
        F.substring("value", F.lit(1), end - 1).cast("bigint").alias("page"),
        F.substring("value", end + 1, F.length("value")).alias("value"),
    )


def write_context(docs: DataFrame, path: str) -> None:
    """The whole context as sorted text files, one flattened document a line.

    The files read in name order are the single joined text; no task or driver
    ever holds more than a document.
    """
    ordered = flatten_documents(docs).orderBy("doc_id")
    ordered.select("text").write.mode("errorifexists").text(path)


# Bytes of a chunk of the addressable context.
CHUNK = 64 << 20
PIECES = "start bigint, size bigint, bytes binary, chunk bigint"


def write_addressable(docs: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """The whole context, flattened documents joined by line feeds, so that any range of its bytes can be read.

    Every document's place is the sum of the bytes before it. It lies in pieces, none
    of which reaches across a multiple of ``chunk``; a piece knows where it starts,
    and the chunks are directories.
    """
    placed = _numbered(docs.where("text IS NOT NULL"), flatten_text(F.col("text")))
    entry = F.to_binary(F.concat("text", F.lit("\n")), F.lit("utf-8"))
    spans = placed.select(F.col("before").alias("from"), (F.col("before") + F.octet_length(entry)).alias("to"), entry.alias("entry"))
    first, last = F.floor(F.col("from") / chunk), F.floor((F.col("to") - 1) / chunk)
    pieces = spans.select("*", F.explode(F.sequence(first, last)).alias("chunk"))
    start, stop = F.greatest(F.col("from"), F.col("chunk") * chunk), F.least(F.col("to"), (F.col("chunk") + 1) * chunk)
    own = F.substring("entry", (start - F.col("from") + 1).cast("int"), (stop - start).cast("int"))
    write_table(pieces.select(start.alias("start"), (stop - start).alias("size"), own.alias("bytes"), "chunk"), path, ["chunk"])


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``range_id`` and the bytes of the context in [begin, stop) for every row of ``ranges``.

    Only pieces that a range touches come together, so a result is never more than
    the range that was asked for. The context ends in a line feed.
    """
    asked = ranges.where("begin < stop").select("range_id", "begin", "stop")
    touched = F.sequence(F.floor(F.col("begin") / chunk), F.floor((F.col("stop") - 1) / chunk))
    asked = asked.select("*", F.explode(touched).alias("chunk"))
    pieces = spark.read.schema(PIECES).parquet(path)
    met = pieces.join(asked, "chunk").where("start < stop AND start + size > begin")
    low = F.greatest(F.col("begin"), F.col("start"))
    high = F.least(F.col("stop"), F.col("start") + F.col("size"))
    part = F.substring("bytes", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    parts = met.select("range_id", "start", part.alias("part"))
    return parts.groupBy("range_id").agg(F.expr("listagg(part) WITHIN GROUP (ORDER BY start)").alias("bytes"))


def document_places(docs: DataFrame) -> DataFrame:
    """Where each document begins in the addressable context, and how many bytes it has there, its line feed among them."""
    placed = _numbered(docs.where("text IS NOT NULL"), flatten_text(F.col("text")))
    return placed.select("doc_id", F.col("before").alias("begin"), (F.octet_length("text") + 1).cast("bigint").alias("size"))
