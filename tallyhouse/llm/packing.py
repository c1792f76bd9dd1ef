"""Packing along a space-filling curve: similar documents stand next to each other, sequences are full.

A document is a vector of hashed id counts, projected to a few dimensions; its
place on the Hilbert curve through them is its key. Documents follow each other
in key order as one stream of ids, which is cut every ``length`` ids, so only the
last sequence of all is short of ids. That one is padded to ``length`` unless it
has a power of two of them.

A null text is an empty one; every document has at least its closing id. Rows
are told apart by a key of their own, so null or repeated ids are packed like any
others. Equal keys, as those of copies, are ordered by that key and split freely.
An empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import partitions, sliced, texts
from tallyhouse.llm.word_tokens import encoder, vocabulary_path
from tallyhouse.session import stored

DIMENSIONS, BITS = 3, 10  # the curve's key has 30 bits
HASHED = 512  # entries of a document vector
END = 1
PIECES = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of cells (rows of coordinates below 2**bits), by undoing the curve's turns bit by bit."""
    x = cells.astype(np.int64).T.copy()
    dimensions = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dimensions):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dimensions):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        gray = np.where((x[-1] & q) != 0, gray ^ (q - 1), gray)
        q >>= 1
    x ^= gray
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dimensions):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _projection() -> np.ndarray:
    """A row for every 16-bit id: the projected unit vector of the entry it is hashed to."""
    entry = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 9)
    return np.random.default_rng(4).normal(0, 1, (HASHED, DIMENSIONS)).astype(np.float32)[entry.astype(np.int64)]


def _encoded(path: str):
    def encode(batches):
        projection, tokens = _projection(), encoder(path)
        closing = np.array([END], "<u2").tobytes()
        for b in sliced(batches):
            ids = [x + closing for x in tokens.encode(b.column("text").to_pylist())]
            flat = np.frombuffer(b"".join(ids), "<u2")
            sizes = np.array([len(x) // 2 for x in ids], np.int64)
            vectors = np.empty((len(ids), DIMENSIONS))
            for k in range(DIMENSIONS):  # shares of the hashed entries, projected
                total = np.concatenate([[0], np.cumsum(projection[flat, k], dtype=np.float64)])
                vectors[:, k] = np.diff(total[np.concatenate([[0], np.cumsum(sizes)])]) / sizes
            cells = np.clip((np.tanh(3 * vectors) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
            columns = [b.column("row"), b.column("id"), pa.array(hilbert_key(cells)), pa.array(sizes), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "key", "size", "ids"])

    return encode


def _running(batches):
    """Ids before each document within its partition of the curve."""
    total = 0
    for b in batches:
        sizes = b.column("size").to_numpy()
        done = total + np.cumsum(sizes)
        total = int(done[-1]) if len(done) else total
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("part"), pa.array(done - sizes), b.column("size")], names=["row", "part", "before", "size"])


def _cutting(length: int):
    def cut(batches):
        for b in sliced(batches, "ids"):
            out: dict[str, list] = {name: [] for name in ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for own, packed, first in zip(*(b.column(c).to_pylist() for c in ("id", "ids", "first")), strict=True):
                ids = np.frombuffer(packed, "<u2").astype("<u4")
                n, at = len(ids), 0
                while at < n:
                    sequence, offset = divmod(first + at, length)
                    size = min(length - offset, n - at)
                    for name, x in zip(out, (own, at, size, ids[at : at + size].tobytes(), n, sequence, offset), strict=True):
                        out[name].append(x)
                    at += size
            yield pa.RecordBatch.from_pydict(
                {name: pa.array(x, pa.binary() if name == "ids" else pa.int64()) for name, x in out.items()}
            )

    return cut


def pack(df: DataFrame, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """A row per piece: ``id_col``, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Texts are encoded once and stored. Only keys and sizes are sorted, by range;
    running sums within a range and the sums of the ranges, a number for each,
    give every document its place. Ids move once, to meet that place.
    """
    spark = df.sparkSession
    docs = texts(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    encoded = stored(
        docs.mapInArrow(_encoded(path or vocabulary_path()), "row long, id long, key long, size long, ids binary"), "encoded"
    )
    order = (
        encoded.select("row", "key", "size")
        .repartitionByRange(partitions(spark), "key", "row")
        .sortWithinPartitions("key", "row")
        .select("row", "size", F.spark_partition_id().cast("long").alias("part"))
    )
    placed = stored(order.mapInArrow(_running, "row long, part long, before long, size long"), "placed")
    sums, total, starts = placed.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect(), 0, []
    for r in sums:  # a row for each range
        starts.append((r["part"], total))
        total += r["n"]
    ranges = spark.createDataFrame(starts, "part long, ahead long")
    firsts = placed.join(F.broadcast(ranges), "part").select("row", (F.col("ahead") + F.col("before")).alias("first"))
    pieces = encoded.select("row", "id", "ids").join(firsts, "row").select("id", "ids", "first")
    return pieces.mapInArrow(_cutting(length), PIECES).withColumnRenamed("id", id_col)
