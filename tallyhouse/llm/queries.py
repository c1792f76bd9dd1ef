"""The registered queries of the training-data operators, one each, over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import byte_bpe
from tallyhouse.llm.alignment import align
from tallyhouse.llm.common import table
from tallyhouse.llm.embedding_dedup import embedding_dedup
from tallyhouse.llm.exact_dedup import exact_dedup
from tallyhouse.llm.fingerprints import compared_to_next
from tallyhouse.llm.minhash_dedup import minhash_dedup
from tallyhouse.llm.packing import pack
from tallyhouse.llm.periodic_runs import periodic_runs
from tallyhouse.llm.quality import quality
from tallyhouse.llm.suffix_dedup import suffix_dedup
from tallyhouse.llm.token_shards import training_order
from tallyhouse.llm.toxicity import toxicity
from tallyhouse.llm.warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What stays, also as a text: U+FFFD stands for characters that a span has cut through.
    kept = F.make_valid_utf8(F.col("kept").cast("string"))
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        kept.alias("text"),
    )


@register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


@register
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    columns = ("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return pieces.select(*columns)


@register
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@register
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@register
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


@register
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_round_trip(table(spark, sf_dir, "pages"))
    return records.selectExpr("id AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, its language's limits, and whether it is kept."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the training order: where it is, what it was made of, and the checksum of what is read there."""
    slots = training_order(table(spark, sf_dir, "documents"))
    return slots.select("slot", "shard", "offset", "sequence", "n_tokens", "doc_ids", "crc32", "read_crc32")


@register
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut by two tokenizers, and how well known its links are."""
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    written = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return align(table(spark, sf_dir, "documents")).select("doc_id", *numbers, written)


@register
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text, as ``hash@place`` of each mark, and what it is like."""
    found = compared_to_next(table(spark, sf_dir, "documents"))

    def written(marks: str) -> Column:
        return F.array_join(F.transform(marks, lambda m: F.concat(F.hex(m["hash"]), F.lit("@"), m["position"])), " ")

    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written("marks").alias("fingerprint"),
        written("edited_marks").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text by its id's checksum repeats a stretch of its words from some place on to its end."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document's words, the longest one, and the text without what repeats."""
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=looped)
    # The greatest length, then the least start and period.
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select("*", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
