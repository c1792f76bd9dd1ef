"""Training order on disk: sequences of ids in shards of fixed stride, by a keyed permutation.

Ids of all texts, each closed by an end id, run on within an input partition and
are cut into sequences of equal length; the last one of a partition is filled up
with the end id. Sequences are numbered through all partitions, and a Feistel
network over the numbers, walked on until it falls below their count, is a
bijection that gives every sequence its slot. A shard holds the slots of one
range in order, each at its place times the stride, so a reader can begin or go on
at any slot with one division.

Nothing but the key and the count decides the order. Shards of lost or repeated
task attempts stay unread, as the stored index names the files that count. A null
text is an empty one and still has its end id. Null and repeated ids are documents
like any others, and an empty table gives no shards.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import make_dir, sliced, texts, write_file
from tallyhouse.llm.word_tokens import encoder, vocabulary_path
from tallyhouse.session import fresh_dir, stored

END = 49407  # the vocabulary's own end of text; ids take two bytes
ROUNDS = 6
INDEX = "slot long, shard long, file string, offset long, sequence long, n_tokens long, doc_ids array<long>, crc32 long"


def slots(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slots below ``count`` of some numbers below ``count``."""
    half = np.uint64(max(1, -(-(count - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(1, 2**63, ROUNDS, dtype=np.uint64)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return left << half | right

    out = network(numbers.astype(np.uint64))
    while (beyond := out >= count).any():
        out[beyond] = network(out[beyond])
    return out.astype(np.int64)


def _stream(batches, path: str):
    """(ids, id of each document, its number of ids) of each batch."""
    closing = np.array([END], "<u2").tobytes()
    for b in sliced(batches):
        packed = [x + closing for x in encoder(path).encode(b.column("text").to_pylist())]
        yield np.frombuffer(b"".join(packed), "<u2"), b.column("id").to_pylist(), [len(x) // 2 for x in packed]


def _counting(length: int, path: str):
    def count(batches):
        total = sum(len(ids) for ids, _, _ in _stream(batches, path))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "sequences": pa.array([-(-total // length)], pa.int64())})

    return count


def _sequencing(length: int, path: str, ahead: dict[int, tuple[int, int]], count: int, key: int):
    def sequence(batches):
        part = TaskContext.get().partitionId()
        number, planned = ahead.get(part, (0, 0))
        last = number + planned
        kept, owners, sizes = np.zeros(0, "<u2"), [], []

        def rows(ids: np.ndarray, owners: list, sizes: list) -> pa.RecordBatch:
            nonlocal number
            n = -(-len(ids) // length)
            if number + n > last:
                raise ValueError("a partition has changed since it was counted; store the input first")
            full = np.concatenate([ids, np.full(n * length - len(ids), END, "<u2")])
            ends, edges = np.cumsum(sizes), np.arange(n) * length
            first = np.searchsorted(ends, edges, side="right").tolist()
            past = (np.searchsorted(ends, np.minimum(edges + length, len(ids)), side="left") + 1).tolist()
            numbers = np.arange(number, number + n)
            number += n
            raw = full.tobytes()
            return pa.RecordBatch.from_pydict(
                {
                    "slot": pa.array(slots(numbers, count, key)),
                    "sequence": pa.array(numbers),
                    "n_tokens": pa.array(np.minimum(length, len(ids) - edges)),
                    "doc_ids": pa.array([owners[a:b] for a, b in zip(first, past, strict=True)], pa.list_(pa.int64())),
                    "ids": pa.array([raw[i : i + 2 * length] for i in range(0, len(raw), 2 * length)], pa.binary()),
                }
            )

        for ids, own, lengths in _stream(batches, path):
            ids, owners, sizes = np.concatenate([kept, ids]), owners + own, sizes + lengths
            whole = len(ids) // length * length
            if whole:
                yield rows(ids[:whole], owners, sizes)
            kept, rest = ids[whole:], len(ids) - whole
            at, left = len(sizes), 0
            while left < rest:  # the documents of what is left over
                at -= 1
                left += sizes[at]
            owners, sizes = owners[at:], sizes[at:]
            if sizes:
                sizes[0] -= left - rest
        if len(kept):
            yield rows(kept, owners, sizes)
        if number != last:
            raise ValueError("a partition has changed since it was counted; store the input first")

    return sequence


def _writing(folder: str, shard_sequences: int, length: int):
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        shard, stride = int(rows["shard"].iloc[0]), 2 * length
        places = rows["slot"].to_numpy() - shard * shard_sequences
        if not (places == np.arange(len(rows))).all():
            raise ValueError(f"slots are missing from shard {shard}")
        name = f"shard-{shard:09d}-{uuid.uuid4().hex}.bin"
        write_file(folder, name, b"".join(rows["ids"]))
        return pd.DataFrame(
            {
                "slot": rows["slot"],
                "shard": shard,
                "file": name,
                "offset": places * stride,
                "sequence": rows["sequence"],
                "n_tokens": rows["n_tokens"],
                "doc_ids": rows["doc_ids"],
                "crc32": [zlib.crc32(x) for x in rows["ids"]],
            }
        )

    return write


def write_shards(
    df: DataFrame,
    folder: str,
    length: int = 1024,
    shard_sequences: int = 8192,
    key: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Write all shards; the stored index comes back, a row per slot.

    Texts are encoded twice, once to count sequences by partition and once to cut
    them, which takes less room than to store the ids in between: they are
    shuffled once, straight to the range of slots that makes a shard.
    """
    where = path or vocabulary_path()
    make_dir(folder)
    docs = texts(df, id_col, text_col)
    counted = docs.mapInArrow(_counting(length, where), "part long, sequences long").collect()  # a row per partition
    ahead, count = {}, 0
    for r in sorted(counted, key=lambda r: r["part"]):
        ahead[r["part"]] = (count, r["sequences"])
        count += r["sequences"]
    kinds = "slot long, sequence long, n_tokens long, doc_ids array<long>, ids binary"
    cut = docs.mapInArrow(_sequencing(length, where, ahead, count, key), kinds)
    shards = cut.withColumn("shard", F.floor(F.col("slot") / shard_sequences))
    return stored(shards.groupBy("shard").applyInPandas(_writing(folder, shard_sequences, length), INDEX), "shard-index")


def read_shards(spark: SparkSession, index: DataFrame, folder: str, length: int = 1024, begin: int = 0) -> DataFrame:
    """``slot`` and ids (binary, little-endian unsigned 16-bit) of all slots from ``begin`` on, shard by shard in order of slots."""
    stride = 2 * length

    def read(batches):
        for b in batches:
            for first, data in zip(b.column("first").to_pylist(), b.column("content").to_pylist(), strict=True):
                skip = max(0, begin - first)
                found = [data[i : i + stride] for i in range(skip * stride, len(data), stride)]
                numbers = pa.array(np.arange(first + skip, first + skip + len(found)))
                yield pa.RecordBatch.from_arrays([numbers, pa.array(found, pa.binary())], names=["slot", "ids"])

    wanted = index.filter(F.col("slot") >= begin).select("file").distinct()
    firsts = index.filter("offset = 0").select("file", F.col("slot").alias("first")).join(wanted, "file", "left_semi")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(firsts, "file").select("first", "content").mapInArrow(read, "slot long, ids binary")


def training_order(df: DataFrame, **options) -> DataFrame:
    """Shards under the shared folder, read back: the index with ``read_crc32`` of what each slot holds."""
    spark, folder = df.sparkSession, fresh_dir(df.sparkSession, "shards")
    index = write_shards(df, folder, **options)
    read = read_shards(spark, index, folder, options.get("length", 1024))
    return index.join(read.select("slot", F.crc32("ids").alias("read_crc32")), "slot")
