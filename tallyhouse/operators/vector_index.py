"""A stored index of vectors: inverted lists around centroids, searched exactly or fast.

Centroids are fitted in one task on a bounded sample of the rows; then every row
goes to the list of its nearest centroid, together with its distance from it. A
search reads the lists near a query first. That gives a bound for its ``k``-th
distance, and by the triangle inequality a list whose centroid is further away than
its radius and that bound together cannot hold a better one. An exact search reads
all the others; a fast one stops after some lists and may miss neighbours. How many
lists that takes depends on how far the rows lie apart, so it is measured on a sample.

Lists are directories, so only those asked for are read. Lists that lie side by
side share a block of bounded size, and so do queries; a block of queries meets
each block of lists that any of them looks at once, and a list too large for one
is cut into several. A query carries a bit for each list, so what it looks at takes
no more room however many lists that are. The driver keeps the centroids, of
which there are at most ``LISTS``.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.operators.nearest import BLOCK_QUERIES, BLOCK_VECTORS, RESULT
from tallyhouse.operators.nearest import STRIDE as ASKED
from tallyhouse.operators.nearest import _nearest_of
from tallyhouse.session import stored
from tallyhouse.sources.tables import write_table

# The functions below travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTS = 4096  # at most; else the square root of the number of rows
SAMPLE = 65_536  # rows that centroids are fitted on, about; all of a smaller table
ROUNDS = 10  # of fitting
SLACK = 1e-6  # of the vectors' lengths, on bounds: distances from centroids are by products, which is far more exact
STRIDE = 1024  # rows that are held against all centroids at once

ROWS = "vec_id bigint, embedding array<float>, away double, list int"
CENTROIDS = "list int, centroid array<double>, n bigint, radius double"


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame
    centroids: DataFrame


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids**2).sum(1)


def _matrix(rows: pd.Series) -> np.ndarray:
    if len({len(v) for v in rows}) > 1:
        raise ValueError("embeddings of different length in one table")
    return np.stack(rows.to_numpy()).astype(np.float64)


def _fitting(lists: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows.sort_values("vec_id")["embedding"])
        x = np.unique(x, axis=0)  # equal vectors make one centroid at most
        rng = np.random.default_rng(0)
        centroids = x[np.sort(rng.permutation(len(x))[:lists])]
        for _ in range(ROUNDS):
            own = np.concatenate([_squares(x[a : a + STRIDE], centroids).argmin(1) for a in range(0, len(x), STRIDE)])
            sums = np.zeros_like(centroids)
            np.add.at(sums, own, x)
            n = np.bincount(own, minlength=len(centroids))
            centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        return pd.DataFrame({"list": np.arange(len(centroids)), "centroid": list(centroids)})

    return fit


def _assigning(centroids: np.ndarray):
    def assign(batches):
        for rows in batches:
            for a in range(0, len(rows), STRIDE):
                some = rows.iloc[a : a + STRIDE]
                x = _matrix(some["embedding"])
                if x.shape[1] != centroids.shape[1]:
                    raise ValueError(f"embeddings of different length: {x.shape[1]} and {centroids.shape[1]}")
                own = _squares(x, centroids).argmin(1)
                away = np.sqrt(((x - centroids[own]) ** 2).sum(1))
                yield pd.DataFrame({"vec_id": some["vec_id"], "embedding": some["embedding"], "away": away, "list": own})

    return assign


def build_index(vectors: DataFrame, path: str, lists: int | None = None, sample_rows: int = SAMPLE) -> VectorIndex:
    """Index all ``vectors(vec_id, embedding)`` at ``path``; rows without an embedding are left out.

    The sample is every row whose hashed id falls below a share that gives about
    ``sample_rows`` of them. The table of centroids is written last, so an index
    that was not finished cannot be loaded.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    n = vectors.count()
    lists = min(LISTS, lists or int(np.ceil(np.sqrt(n))) or 1)
    share = min(1.0, sample_rows / max(1, n))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    fitted = sample.groupBy().applyInPandas(_fitting(lists), "list int, centroid array<double>").collect()
    fitted.sort(key=lambda r: r["list"])
    if fitted:
        found = vectors.mapInPandas(_assigning(np.array([r["centroid"] for r in fitted])), ROWS)
    else:  # nothing to fit
        found = spark.createDataFrame([], ROWS)
    write_table(found, f"{path}/lists", ["list"])
    rows = spark.read.schema(ROWS).parquet(f"{path}/lists")
    measured = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    centroids = spark.createDataFrame([(r["list"], r["centroid"]) for r in fitted], "list int, centroid array<double>")
    centroids.join(measured, "list").select("list", "centroid", "n", "radius").write.parquet(f"{path}/centroids")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    centroids = spark.read.parquet(f"{path}/centroids")  # not there before an index is whole
    return VectorIndex(spark.read.schema(ROWS).parquet(f"{path}/lists"), centroids)


def _near_lists(y: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_squares(y, centroids), 0))


def _first_lists(distance: np.ndarray, n: np.ndarray, k: int, probes: int | None) -> np.ndarray:
    """The places, by distance of their centroids, of the lists that are read first."""
    order = np.argsort(distance, kind="stable")
    if probes is not None:
        return order[:probes]
    return order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]


def _side_by_side(centroids: np.ndarray) -> np.ndarray:
    """An order in which near centroids stand close to each other: halved along the widest coordinate, again and again."""

    def halved(at: np.ndarray) -> list[np.ndarray]:
        if len(at) < 3:
            return [at]
        x = centroids[at]
        at = at[np.argsort(x[:, (x.max(0) - x.min(0)).argmax()], kind="stable")]
        return halved(at[: len(at) // 2]) + halved(at[len(at) // 2 :])

    return np.concatenate(halved(np.arange(len(centroids))))


def _dealt(sizes: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each place and how many it has: small ones share one, in this order, larger ones have some of their own."""
    first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block = filled = 0
    for i in order.tolist():
        size = int(sizes[i])
        if filled and filled + size > most:
            block, filled = block + 1, 0
        first[i], count[i] = block, max(1, -(-size // most))
        block, filled = (block, filled + size) if size <= most else (block + int(count[i]), 0)
    return first, count


def _choosing(
    lists: np.ndarray, centroids: np.ndarray, n: np.ndarray, radius: np.ndarray, k: int, probes: int | None, more: bool,
    blocks: tuple[np.ndarray, np.ndarray] | None = None,
):
    """The lists each query has to look at, a bit for each: the first ones, or of the others those within its bound.

    With the first block of each list and how many it has, the blocks of these too; without, every list is one.
    """

    longest = np.sqrt((centroids**2).sum(1)).max()
    first, count = blocks or (np.arange(len(lists)), np.ones(len(lists), np.int64))

    def choose(batches):
        for rows in batches:
            for a in range(0, len(rows), STRIDE):
                some = rows.iloc[a : a + STRIDE]
                y = _matrix(some["embedding"])
                distances = _near_lists(y, centroids)
                marked = np.zeros(distances.shape, bool)
                for i, distance in enumerate(distances):
                    chosen = _first_lists(distance, n, k, probes)
                    if more:
                        reach = some["reach"].iloc[i] + SLACK * (1 + np.sqrt((y[i] ** 2).sum()) + longest)
                        marked[i] = distance - radius <= reach
                        marked[i, chosen] = False
                    else:
                        marked[i, chosen] = True
                yield pd.DataFrame(
                    {
                        "query_id": some["query_id"],
                        "embedding": some["embedding"],
                        "home": distances.argmin(1) if len(some) else np.zeros(0, int),
                        "lists": [x.tobytes() for x in np.packbits(marked, axis=1)],
                        "blocks": [_blocks_of(first, count, x) for x in marked],
                    }
                )

    return choose


def _blocks_of(first: np.ndarray, count: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The blocks that hold the marked lists, each once."""
    first, count = first[marked], count[marked]
    return np.unique(np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum()))


CHOSEN = "query_id bigint, embedding array<float>, home int, lists binary, blocks array<bigint>"


def _any_of(batches):
    """The lists that any query looks at, one row for a task."""
    found = None
    for rows in batches:
        for lists in rows["lists"]:
            own = np.frombuffer(lists, np.uint8)
            found = own.copy() if found is None else found | own
    if found is not None:
        yield pd.DataFrame({"lists": [found.tobytes()]})


def _best_of_lists(k: int):
    """The best ``k`` of each query in a block, of the lists it looks at."""

    def best(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        vectors, queries = vectors.sort_values("vec_id"), queries.sort_values(["home", "query_id"])
        ids, asked, x = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy(), _matrix(vectors["embedding"])
        places, own = np.unique(vectors["place"].to_numpy(), return_inverse=True)
        parts = []
        for a in range(0, len(asked), ASKED):
            some = queries.iloc[a : a + ASKED]
            y = _matrix(some["embedding"])
            if x.shape[1] != y.shape[1]:
                raise ValueError(f"embeddings of different length: {x.shape[1]} and {y.shape[1]}")
            marks = np.frombuffer(b"".join(some["lists"]), np.uint8).reshape(len(some), -1)
            marked = np.unpackbits(marks, axis=1)[:, places].astype(bool)
            used = marked.any(0)[own]
            if used.any():
                parts.append(_nearest_of(asked[a : a + ASKED], y, ids[used], x[used], k, marked[:, own[used]]))
        if not parts:
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        query, vec, distance = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pd.DataFrame({"query_id": query, "vec_id": vec, "distance": distance})

    return best


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """``k`` nearest vectors per ``queries(query_id, embedding)``: query_id, vec_id, distance and rank, as ``nearest`` gives them.

    Without ``probes`` the result is exact. With them, only so many lists around
    each query are read.
    """
    spark = queries.sparkSession
    queries = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    known = index.centroids.orderBy("list").collect()
    if not known:
        return spark.createDataFrame([], f"{RESULT}, rank int")
    lists, n, radius, centroids = (np.array([r[c] for r in known]) for c in ("list", "n", "radius", "centroid"))
    order = _side_by_side(centroids)
    blocks = _dealt(n, order, BLOCK_VECTORS)
    of_lists = (lists, centroids, n, radius, k, probes)
    of_blocks = (lists, order, *blocks)
    first = _visited(index, queries.mapInPandas(_choosing(*of_lists, more=False, blocks=blocks), CHOSEN), of_blocks, k)
    if probes is None:
        first = stored(first, "first-neighbours")
        reached = _ranked(first, k).groupBy("query_id").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("found"))
        bound = F.when(F.col("found") >= k, F.col("reach")).otherwise(F.lit(float("inf"))).alias("reach")
        bounded = queries.join(reached.select("query_id", bound), "query_id")
        first = first.unionByName(_visited(index, bounded.mapInPandas(_choosing(*of_lists, more=True, blocks=blocks), CHOSEN), of_blocks, k))
    return _ranked(first, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visited(index: VectorIndex, chosen: DataFrame, of_blocks: tuple[np.ndarray, ...], k: int) -> DataFrame:
    """The best ``k`` of each query in every block of the lists it looks at.

    Queries meet a block together with others of near home lists, which look at
    about the same lists, at most about ``BLOCK_QUERIES`` at once.
    """
    spark = chosen.sparkSession
    lists, order, first, count = of_blocks
    chosen = stored(chosen, "chosen-lists")
    looked = [np.frombuffer(r["lists"], np.uint8) for r in chosen.select("lists").mapInPandas(_any_of, "lists binary").collect()]
    if not looked:
        return spark.createDataFrame([], RESULT)
    places = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(looked))[: len(lists)]).tolist()
    asking = np.zeros(len(lists), np.int64)
    for r in chosen.groupBy("home").count().collect():  # a row for each list at most
        asking[r["home"]] = r["count"]
    of_queries = _dealt(asking, order, BLOCK_QUERIES)
    homes = [(i, int(of_queries[0][i]), int(of_queries[1][i])) for i in np.flatnonzero(asking).tolist()]
    dealt = F.broadcast(spark.createDataFrame(homes, "home int, first_part bigint, parts bigint"))
    part = (F.col("first_part") + F.pmod(F.xxhash64("query_id"), F.col("parts"))).alias("part")
    asked = chosen.join(dealt, "home").select("query_id", "embedding", "home", "lists", part, F.explode("blocks").alias("block"))
    own = [(int(lists[i]), i, int(first[i]), int(count[i])) for i in places]
    dealt = F.broadcast(spark.createDataFrame(own, "list int, place int, first_block bigint, of_list bigint"))
    rows = index.rows if len(places) == len(lists) else index.rows.where(F.col("list").isin([int(lists[i]) for i in places]))
    block = (F.col("first_block") + F.pmod(F.xxhash64("vec_id"), F.col("of_list"))).alias("block")
    met = asked.select(F.col("block").alias("of_block"), F.col("part").alias("of_part")).distinct()
    vectors = rows.join(dealt, "list").select("vec_id", "embedding", "place", block).join(met, F.col("block") == F.col("of_block"))
    vectors = vectors.select("vec_id", "embedding", "place", "of_block", "of_part")
    return vectors.groupBy("of_block", "of_part").cogroup(asked.groupBy("block", "part")).applyInPandas(_best_of_lists(k), RESULT)


def _list_ranks(lists: np.ndarray, centroids: np.ndarray):
    """How many lists lie nearer to a query than that of its neighbour, and that one."""
    place = {own: i for i, own in enumerate(lists.tolist())}

    def rank(batches):
        for rows in batches:
            for a in range(0, len(rows), STRIDE):
                some = rows.iloc[a : a + STRIDE]
                order = np.argsort(_near_lists(_matrix(some["embedding"]), centroids), axis=1, kind="stable")
                at = np.argsort(order, axis=1)[np.arange(len(some)), [place[x] for x in some["list"]]]
                yield pd.DataFrame({"probes": at + 1})

    return rank


def probes_for(index: VectorIndex, queries: DataFrame, k: int, target: float) -> int:
    """The least number of lists that gives a fast search this recall on some queries, measured against their exact neighbours.

    Give it a bounded sample of what will be asked: these are searched exactly.
    """
    known = index.centroids.orderBy("list").collect()
    exact = search(index, queries, k).select("query_id", "vec_id")
    at = exact.join(index.rows.select("vec_id", "list"), "vec_id").join(queries.select("query_id", "embedding"), "query_id")
    ranks = at.select("embedding", "list").mapInPandas(
        _list_ranks(np.array([r["list"] for r in known]), np.array([r["centroid"] for r in known])), "probes bigint"
    )
    counts = ranks.groupBy("probes").count().orderBy("probes").collect()  # a row for each list at most
    needed, so_far = target * sum(r["count"] for r in counts), 0
    for r in counts:
        so_far += r["count"]
        if so_far >= needed:
            return r["probes"]
    return max(1, len(known))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many neighbours there are, and the share of them that ``found`` has."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("neighbours"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
