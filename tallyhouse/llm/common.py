"""What several operators share: clean inputs, keyed rows, files under the shared folder."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the stated columns, under the operator's own names.

    Every operator starts with this, so extra columns of the input, whatever
    they are called, can neither clash with its own nor be read.
    """
    return df.select(*[F.col(f"`{name}`").alias(own) for own, name in columns.items()])


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` (long, may be null) and ``text`` (null becomes empty)."""
    return picked(df, id=id_col, text=text_col).select(
        F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, about ``size`` bytes of a column at a time, so that what is made of them stays small."""
    for b in batches:
        if b.num_rows:
            own = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)) // size
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), b.num_rows]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                yield b.slice(start, stop - start)


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions whoever runs the cluster has asked for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store behind a URI and the path in it, for a task that writes plain files."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_file(uri: str, name: str, data: bytes) -> None:
    store, path = filesystem(uri)
    with store.open_output_stream(posixpath.join(path, name), compression=None) as out:
        out.write(data)


def make_dir(uri: str) -> None:
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)
