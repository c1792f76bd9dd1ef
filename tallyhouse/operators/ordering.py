"""Running numbers and sums over a whole table, without bringing it together."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import stored

# The functions below travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _summing(batches):
    """Rows and sums before each row within its range; ranges follow one another in a task, if there are several."""
    part, row, total = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        parts, sizes = b.column("_part").to_numpy(), pc.cast(b.column("_size"), pa.int64()).to_numpy()
        rows, before = np.arange(b.num_rows), np.cumsum(sizes) - sizes
        begins = np.flatnonzero(np.concatenate([[parts[0] != part], parts[1:] != parts[:-1]]))
        # What a range that goes on from the last batch has already.
        group = np.searchsorted(begins, np.arange(b.num_rows), side="right") - 1
        base_row = np.where(group >= 0, rows[begins][group] if len(begins) else 0, -row)
        base_sum = np.where(group >= 0, before[begins][group] if len(begins) else 0, -total)
        rows, before = rows - base_row, before - base_sum
        part, row, total = parts[-1], int(rows[-1]) + 1, int(before[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows), pa.array(before)], names=[*b.schema.names, "_row", "_before"])


def running(df: DataFrame, order: Sequence[str | Column], size: Column, number: str = "row", before: str = "before") -> DataFrame:
    """``df`` with its running row number and the sum of ``size`` over all rows before it, both from 0.

    Rows are sorted by range and stored once; inside a range sums are made as rows go
    by, and the totals of the ranges, a row for each, give every range its place.
    """
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    keyed = df.select("*", size.cast("bigint").alias("_size"), *[k.alias(f"_key{i}") for i, k in enumerate(keys)])
    names = [f"_key{i}" for i in range(len(keys))]
    sorted_ = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    sorted_ = sorted_.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*sorted_.schema, T.StructField("_row", T.LongType()), T.StructField("_before", T.LongType())])
    placed = stored(sorted_.mapInArrow(_summing, schema), "ordered")
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    starts = totals.select(
        F.col("_part").alias("_of"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_ahead{c}") for c in ("_n", "_sum")]
    )
    joined = placed.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    columns = [c for c in df.columns]
    return joined.select(*columns, (F.col("_row") + F.col("_ahead_n")).alias(number), (F.col("_before") + F.col("_ahead_sum")).alias(before))
