"""A corpus made ready for training, stage after stage, each over all that the one before has kept.

A ``doc_id`` names a document: rows that share one share its fate in the stages
that drop documents. A row without an id cannot be named, so those stages keep it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import table
from tallyhouse.llm.exact_dedup import exact_dedup
from tallyhouse.llm.minhash_dedup import minhash_dedup
from tallyhouse.llm.packing import pack
from tallyhouse.llm.suffix_dedup import suffix_dedup
from tallyhouse.llm.toxicity import toxicity
from tallyhouse.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).join(dropped.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return _without(docs, toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, once."""
    return _without(docs, exact_dedup(docs).filter(~F.col("kept"))).dropDuplicates(["doc_id", "text"])


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8."""
    return _without(docs, minhash_dedup(docs, words=5, percent=80).filter(~F.col("kept")))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words, or of 400 bytes, that still occur elsewhere."""
    cut = suffix_dedup(docs, words=51, as_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 ids."""
    columns = ("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return pack(docs).select(*columns)


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", distinct_texts),
    ("minhash_dedup", distinct_contents),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]

# A learned classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
