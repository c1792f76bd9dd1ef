"""A stored vector index against plain comparison of everything."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import nearest, vector_index


def frame(spark, ids, x, key="vec_id"):
    rows = [(int(i), None if v is None else [float(a) for a in v]) for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>")


def plainly(x, y, ids, asked, k):
    out = {}
    for q, v in zip(asked, y, strict=True):
        distance = np.sqrt(((x.astype(np.float32).astype(float) - v.astype(np.float32).astype(float)) ** 2).sum(1))
        order = np.lexsort((ids, distance))[:k]
        out[q] = [(int(ids[i]), round(float(distance[i]), 6)) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["distance"], 6)))
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 4, (12, 8))
    x = centers[rng.integers(0, 12, 1500)] + rng.normal(0, 1, (1500, 8))
    x[::3] = x[0]  # a third of all rows is one vector
    return np.arange(1500), x


@pytest.mark.parametrize("scale", [1, 1e5])
def test_exact_search(spark, tmp_path, clustered, scale, monkeypatch):
    """Also with the hot vector's list cut into blocks, and queries of one home in parts."""
    monkeypatch.setattr(vector_index, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 16)
    ids, x = clustered
    x = x * scale + scale  # away from zero
    asked = ids[::10]
    vector_index.build_index(frame(spark, ids, x), str(tmp_path / "index"))
    index = vector_index.load_index(spark, str(tmp_path / "index"))
    assert index.rows.count() == len(ids)
    got = found(vector_index.search(index, frame(spark, asked, x[asked], "query_id"), 7))
    assert got == plainly(x, x[asked], ids, asked.tolist(), 7)


def test_k_beyond_lists_and_rows(spark, tmp_path, clustered):
    ids, x = clustered
    index = vector_index.build_index(frame(spark, ids[:50], x[:50]), str(tmp_path / "index"), lists=20)
    got = found(vector_index.search(index, frame(spark, [1, 2], x[60:62], "query_id"), 80))
    assert got == plainly(x[:50], x[60:62], ids[:50], [1, 2], 80)


def test_fast_search_reads_few_lists(spark, tmp_path, clustered):
    ids, x = clustered
    index = vector_index.build_index(frame(spark, ids, x), str(tmp_path / "index"))
    queries = frame(spark, ids[::20], x[::20], "query_id")
    exact, fast = vector_index.search(index, queries, 5), vector_index.search(index, queries, 5, probes=8)
    row = vector_index.recall(fast, exact).first()
    assert row["neighbours"] == 75 * 5
    assert 0.9 <= row["recall"] <= 1
    assert index.centroids.count() > 16
    probes = vector_index.probes_for(index, frame(spark, ids[1::40], x[1::40], "query_id"), 5, 0.95)
    assert 1 <= probes <= 8
    assert vector_index.recall(vector_index.search(index, queries, 5, probes), exact).first()["recall"] >= 0.85
    assert vector_index.probes_for(index, queries.limit(0), 5, 0.95) == index.centroids.count()
    assert vector_index.recall(exact, exact).first()["recall"] == 1


def test_far_lists_are_skipped(spark, tmp_path, clustered):
    """Bounds rule out most lists of well separated groups, and a filter on the list reaches the directories."""
    ids, x = clustered
    centers = np.repeat(np.arange(30)[:, None] * 1000.0, 8, 1)
    x = np.repeat(centers, 50, 0) + x[:1500] / 10
    index = vector_index.build_index(frame(spark, ids, x), str(tmp_path / "index"))
    known = index.centroids.orderBy("list").collect()
    lists, n, radius = (np.array([r[c] for r in known]) for c in ("list", "n", "radius"))
    choose = vector_index._choosing(lists, np.array([r["centroid"] for r in known]), n, radius, 5, None, more=True)
    some = frame(spark, [0], x[:1], "query_id").withColumn("reach", F.lit(20.0)).toPandas()
    assert 0 <= len(next(iter(choose([some])))) < len(lists) // 3
    plan = index.rows.where("list = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan


def test_centroids_are_fitted_on_a_sample_and_every_row_is_in_a_list(spark, tmp_path, clustered):
    ids, x = clustered
    index = vector_index.build_index(frame(spark, ids, x), str(tmp_path / "index"), lists=10, sample_rows=100)
    assert index.rows.count() == len(ids)
    assert index.centroids.agg(F.sum("n")).first()[0] == len(ids)
    asked = ids[::100]
    assert found(vector_index.search(index, frame(spark, asked, x[asked], "query_id"), 3)) == plainly(x, x[asked], ids, asked.tolist(), 3)


def test_nothing_and_missing_embeddings(spark, tmp_path):
    empty = frame(spark, [], [])
    index = vector_index.build_index(empty, str(tmp_path / "none"))
    queries = frame(spark, [1, 2], [[0, 0], None], "query_id")
    assert vector_index.search(index, queries, 3).collect() == []
    index = vector_index.build_index(frame(spark, [1, 2, 3], [[0, 1], None, [3, 4]]), str(tmp_path / "some"))
    assert found(vector_index.search(index, queries, 3)) == {1: [(1, 1.0), (3, 5.0)]}
    assert vector_index.search(index, queries.limit(0), 3).collect() == []
    with pytest.raises(Exception, match="length|shape|matmul"):
        vector_index.build_index(frame(spark, [1, 2], [[0, 1], [2]]), str(tmp_path / "odd"))


def test_an_unfinished_index_is_not_loaded(spark, tmp_path, clustered):
    ids, x = clustered
    broken = frame(spark, ids, x).selectExpr("vec_id", "if(vec_id = 700, raise_error('lost'), embedding) AS embedding")
    with pytest.raises(Exception, match="lost"):
        vector_index.build_index(broken, str(tmp_path / "index"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        vector_index.load_index(spark, str(tmp_path / "index"))


def test_same_as_the_search_of_all(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    index = vector_index.build_index(vectors, str(tmp_path / "index"))
    assert found(vector_index.search(index, queries, 10)) == found(nearest.nearest(vectors, queries, 10))


def test_a_query_is_one_row_however_many_lists_it_looks_at():
    """What a task holds and writes of a query does not grow with the number of lists, and near lists share a block."""
    rng = np.random.default_rng(8)
    x, lists = rng.normal(0, 1, (300, 8)), np.arange(300)
    n, radius = np.full(300, 40), np.full(300, 5.0)
    blocks = vector_index._dealt(n, vector_index._side_by_side(x), 400)
    some = pd.DataFrame({"query_id": lists, "embedding": list(x), "reach": 100.0})
    (rows,) = vector_index._choosing(lists, x, n, radius, 5, None, True, blocks)([some])
    marked = np.unpackbits(np.frombuffer(b"".join(rows["lists"]), np.uint8).reshape(300, -1), axis=1)[:, :300]
    assert len(rows) == 300 and (marked.sum(1) == 299).all()  # all but the one that was read first
    assert rows["blocks"].map(len).max() == 30 and rows["lists"].map(len).max() == 38
    some["reach"] = -4.0
    (rows,) = vector_index._choosing(lists, x, n, radius, 5, None, True, blocks)([some])
    marked = np.unpackbits(np.frombuffer(b"".join(rows["lists"]), np.uint8).reshape(300, -1), axis=1)[:, :300]
    assert 0 < marked.sum() < 300 * 299 // 3


def test_large_lists_have_blocks_of_their_own():
    first, count = vector_index._dealt(np.array([3, 100, 4, 5, 0, 9]), np.array([0, 2, 1, 4, 3, 5]), 10)
    assert count.tolist() == [1, 10, 1, 1, 1, 1]
    assert first.tolist() == [0, 1, 0, 11, 11, 12]
    assert vector_index._blocks_of(first, count, np.array([True, True, True, False, False, True])).tolist() == [*range(11), 12]
