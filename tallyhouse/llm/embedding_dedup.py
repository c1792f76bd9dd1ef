"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are turned so that their leading coordinates hold most of their length.
Tiles of them are compared pair by pair: products of the leading coordinates are
summed first, what the others can still add is at most the product of their
norms, and a block, or what is left of it, is given up when no cosine in it can
reach the threshold. Tiles too far apart along the first coordinate never meet.

Vectors that are null, empty, zero, or hold a null or non-finite component link
with nothing, nor do vectors of different lengths with each other. A null id is
kept as a row of its own, without component, and does link. Repeated rows are other
vectors that link with each other; rows with equal ids share a mark. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import picked
from tallyhouse.llm.components import components
from tallyhouse.llm.union import join_groups
from tallyhouse.session import stored

TILE = 4096  # vectors of a tile
STRIPS = 256  # ranges of the first coordinate, at most; crowded ones are several tiles
BLOCK = 512  # vectors compared at a time within a tile
LEADING = (8, 16, 32)  # where sums are held against their bound
SLACK = 1e-9  # cosines this near the threshold are computed again from the given vectors


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _moments(batches):
    """Sums of products of coordinates over a partition."""
    total = None
    for b in batches:
        if b.num_rows:
            x = _unit(_matrix(b.column("vector")))
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size)), "value": pa.array(total.ravel())})


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _first_coordinate(axis: np.ndarray):
    def project(batches):
        for b in batches:
            x = _unit(_matrix(b.column("vector"))) @ axis if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x, pa.float64())], names=[*b.schema.names, "lead"])

    return project


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of all pairs of turned unit vectors whose cosine may reach the threshold."""
    stops = [k for k in LEADING if k < x.shape[1]] + [x.shape[1]]
    products, at = np.zeros((len(x), len(y))), 0
    for k in stops:
        products += x[:, at:k] @ y[:, at:k].T
        at = k
        rest = np.outer(np.linalg.norm(x[:, k:], axis=1), np.linalg.norm(y[:, k:], axis=1))
        i, j = np.nonzero(products + rest >= threshold - SLACK)
        if len(i) * 20 < products.size:  # few are left: go on with these alone
            break
    found = products[i, j]
    for n in [*(k for k in stops if k > at)]:
        found = found + np.einsum("ij,ij->i", x[i, at:n], y[j, at:n])
        at = n
        rest = np.linalg.norm(x[i, n:], axis=1) * np.linalg.norm(y[j, n:], axis=1)
        alive = found + rest >= threshold - SLACK
        i, j, found = i[alive], j[alive], found[alive]
    return i, j, found


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _comparing(axes: np.ndarray, threshold: float):
    def compare(key, rows):
        rows = rows.sort_values(["lead", "class"], kind="stable")
        tiles = [np.flatnonzero(rows["tile"].to_numpy() == t) for t in dict.fromkeys(key)]
        given = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        turned, size = _unit(given) @ axes, rows["size"].to_numpy()
        root, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        own, other = tiles[0], tiles[-1]
        for a in range(0, len(own), BLOCK):
            for b in range(a if len(tiles) == 1 else 0, len(other), BLOCK):
                left, right = own[a : a + BLOCK], other[b : b + BLOCK]
                i, j, cosine = near_pairs(turned[left], turned[right], threshold)
                i, j = left[i], right[j]
                near = cosine >= threshold + SLACK
                for k in np.flatnonzero(~near).tolist():
                    near[k] = _cosine(given[i[k]], given[j[k]]) >= threshold
                if len(tiles) == 1:
                    near &= i < j
                i, j = i[near], j[near]
                links += np.bincount(i, size[j], len(rows)).astype(np.int64) + np.bincount(j, size[i], len(rows)).astype(np.int64)
                join_groups(root, i, j)
        linked, number = links > 0, rows["class"].to_numpy()
        return pd.DataFrame({"class": number[linked], "links": links[linked], "root": number[root[linked]]})

    return compare


def _linked(classes: DataFrame, threshold: float) -> DataFrame:
    """class, links and a linked class of its tile pair, for vectors of one length."""
    spark = classes.sparkSession
    sums = classes.select("vector").mapInArrow(_moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    moments = np.array([r["value"] for r in sums.orderBy("at").collect()])  # length squared numbers
    width = math.isqrt(len(moments))
    axes = np.linalg.eigh(moments.reshape(width, width))[1][:, ::-1].copy()

    columns = "class long, size long, vector array<double>, lead double"
    led = stored(classes.select("class", "size", "vector").mapInArrow(_first_coordinate(axes[:, 0].copy()), columns), "led")
    strips = min(STRIPS, -(-led.count() // TILE))
    cuts = sorted(set(led.approxQuantile("lead", [k / strips for k in range(1, strips)], 0.2 / strips))) if strips > 1 else []
    strip = sum((F.when(F.col("lead") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    led = led.withColumn("strip", strip)
    found = led.groupBy("strip").agg(F.count(F.lit(1)).alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high"))
    known = found.orderBy("strip").collect()  # STRIPS rows at most
    reach = math.sqrt(2 - 2 * threshold) + SLACK if threshold < 1 else SLACK
    base, layout = 0, []
    for r in known:
        layout.append((r, base, -(-r["n"] // TILE)))
        base += layout[-1][2]
    plan = []
    for r, start, n in layout:
        met = [(s, k) for o, s, k in layout if o["low"] <= r["high"] + reach and o["high"] >= r["low"] - reach]
        plan.append((r["strip"], start, n, met[0][0], met[-1][0] + met[-1][1] - 1))
    plan = spark.createDataFrame(plan, "strip int, start long, tiles long, low_tile long, high_tile long")
    tiled = led.join(F.broadcast(plan), "strip").withColumn(
        "tile", F.col("start") + F.pmod(F.xxhash64("class"), F.col("tiles"))
    )
    met = tiled.select("class", "size", "vector", "lead", "tile", F.explode(F.sequence("low_tile", "high_tile")).alias("partner"))
    pairs = met.select(
        "class", "size", "vector", "lead", "tile",
        F.least("tile", "partner").alias("one"), F.greatest("tile", "partner").alias("two"),
    )
    return pairs.groupBy("one", "two").applyInPandas(_comparing(axes, threshold), "class long, links long, root long")


def embedding_dedup(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, n_links, component_id and kept for every row of ``df``.

    Equal vectors are one class from the start, merged in the tasks that read
    them. A vector goes to each pair of tiles its own takes part in; a task holds
    two tiles. Links are counted there and never written one by one: of a pair of
    tiles, each linked vector returns its count and one vector of its group.
    """
    rows = picked(df, id=id_col, vector=vector_col).select(
        F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    classes = stored(
        rows.filter("vector IS NOT NULL")
        .groupBy("vector")
        .agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least_id"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    linked = None
    for r in classes.select(F.size("vector").alias("n")).distinct().orderBy("n").collect():  # lengths of vectors
        own = _linked(classes.filter(F.size("vector") == r["n"]), threshold)
        linked = own if linked is None else linked.union(own)
    if linked is None:
        linked = classes.select("class", F.lit(0).cast("long").alias("links"), F.col("class").alias("root"))
    linked = stored(linked, "linked")
    roots = components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("class").agg(F.sum("links").alias("links"))
    grouped = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    grouped = (
        grouped.join(least, "root")
        .join(counts, "class", "left")
        .select("vector", "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    joined = rows.join(grouped, "vector", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
