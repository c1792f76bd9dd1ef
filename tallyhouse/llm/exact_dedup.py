"""Exact dedup: counting quotient filters find repeated fingerprints, whole bytes decide.

Texts are equal when they are identical after lower-casing A-Z only. A null text
is an empty one, and empty texts equal each other. Of equal texts the row with
the largest id stays; rows that repeat an id and its text cannot be told apart
and share their mark. A null id loses to any other; a group of null ids only has
a null ``keep_id`` and all its rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import quotient_filter as qf
from tallyhouse.llm.common import partitions, sliced, texts


def _normal(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x.lower() for x in column.cast(pa.binary()).to_pylist()]  # bytes.lower() knows A-Z only


def _filters(block_bits: int):
    def build(batches):
        # The filter of a partition: 8 bytes a row while it is built, sorted once.
        prints = [
            np.fromiter((xxhash.xxh3_64_intdigest(x) for x in _normal(b.column("text"))), np.uint64, b.num_rows)
            for b in sliced(batches)
        ]
        found = list(qf.blocks(np.concatenate(prints), block_bits)) if prints else []
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array([x for x, _ in found], pa.int64()), "filter": pa.array([x for _, x in found], pa.binary())}
        )

    return build


def _repeated(block_bits: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        prints, counts = qf.merged(int(rows["block"].iloc[0]), list(rows["filter"]), block_bits)
        return pd.DataFrame({"print": prints[counts > 1].view(np.int64)})

    return merge


def _digests(with_text: bool):
    def digest(batches):
        for b in sliced(batches):
            normal = _normal(b.column("text"))
            columns = {
                "id": b.column("id"),
                "print": pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in normal], np.uint64).view(np.int64)),
                "sha256": pa.array([hashlib.sha256(x).hexdigest() for x in normal], pa.string()),
            }
            if with_text:
                columns["bytes"] = pa.array(normal, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return digest


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, keep_id, group_size, kept and text_sha256 for every row of ``df``.

    1. Each partition builds its quotient filter; filters of a block of
       fingerprints are merged, and what counts more than one is repeated.
    2. Rows with a repeated fingerprint are grouped by their bytes, copies being
       merged in the tasks that read them before anything is shuffled by text.
    3. The groups go back to the rows by digest; a crowded digest is one row on
       the side of the groups, and adaptive execution splits the other side.
    """
    docs = texts(df, id_col, text_col)
    block_bits = max(1, math.ceil(math.log2(4 * partitions(df.sparkSession))))
    repeated = (
        docs.select("text")
        .mapInArrow(_filters(block_bits), "block long, filter binary")
        .groupBy("block")
        .applyInPandas(_repeated(block_bits), "print long")
    )
    digest = "id long, print long, sha256 string"
    suspects = docs.mapInArrow(_digests(True), digest + ", bytes binary").join(repeated, "print", "left_semi")
    groups = (
        suspects.groupBy("sha256", "bytes")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("sha256", "keep_id", "group_size")
    )
    rows = docs.mapInArrow(_digests(False), digest).join(groups, "sha256", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
