"""Joining aggregates of different feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_join_on_key(
    left: DataFrame, right: DataFrame, key: str, measures: Sequence[str]
) -> DataFrame:
    """Full outer join on one merged key; a missing side counts as zero.

    Both sides are aggregates with one row per key, so no key can be hot here.
    """
    a, b = left.alias("a"), right.alias("b")
    merged = F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return joined.select(merged, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])
