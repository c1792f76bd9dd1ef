import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import context, nearest, snapshots
from tallyhouse.sources import landing


def brute_force(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], dtype=np.float64)
    out = set()
    for query_id, q in queries:
        distance = np.sqrt(((x - np.asarray(q, dtype=np.float64)) ** 2).sum(axis=1))
        order = np.lexsort((ids, distance))[:k]
        out |= {(query_id, int(ids[i]), r + 1, round(float(distance[i]), 9)) for r, i in enumerate(order)}
    return out


def frames(spark, vectors, queries):
    return (
        spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(5),
        spark.createDataFrame(queries, "query_id bigint, embedding array<float>"),
    )


def found(df):
    return {
        (r["query_id"], r["vec_id"], r["rank"], round(r["distance"], 9)) for r in df.collect()
    }


def as_floats(matrix):
    return [(i, [float(c) for c in row]) for i, row in enumerate(np.asarray(matrix, np.float32))]


@pytest.fixture
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(scale=8.0, size=(6, 8))
    spread = centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 8))
    copies = np.repeat(spread[:1], 200, axis=0)  # a third of all vectors is one vector
    return as_floats(np.vstack([spread, copies]))


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("block", [(50, 20), (8192, 2048)])
def test_nearest_is_exact(spark, monkeypatch, clustered, block, k):
    monkeypatch.setattr(nearest, "BLOCK_VECTORS", block[0])
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", block[1])
    queries = [(1000 + i, v) for i, v in clustered[350:450]]
    out = nearest.nearest(*frames(spark, clustered, queries), k)
    assert found(out) == brute_force(clustered, queries, k)


def test_fewer_vectors_than_asked_for(spark):
    vectors = as_floats([[0, 0], [3, 4]])
    out = nearest.nearest(*frames(spark, vectors, [(9, [0.0, 0.0])]), 5)
    assert found(out) == {(9, 0, 1, 0.0), (9, 1, 2, 5.0)}


def test_nothing_to_compare(spark):
    vectors, queries = frames(spark, as_floats([[0, 0]]), [(1, [0.0, 0.0])])
    assert nearest.nearest(vectors, queries.limit(0), 3).collect() == []
    assert nearest.nearest(vectors.limit(0), queries, 3).collect() == []


def test_embeddings_of_different_length_fail(spark):
    vectors, queries = frames(spark, [(1, [1.0, 2.0]), (2, [1.0])], [(1, [0.0, 0.0])])
    with pytest.raises(Exception, match="length|shape|matmul"):
        nearest.nearest(vectors.coalesce(1), queries, 1).collect()


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "store")
    v1, v2 = (
        spark.createDataFrame([(1, [float(i)])], "vec_id bigint, embedding array<float>") for i in (1, 2)
    )
    # A day-first stamp would put 13 May after 2 June.
    snapshots.save_vectors(v1, root, "007", "2024-05-13 20:45:46")
    snapshots.save_vectors(v2, root, "007", "2024-06-02 08:00:00")
    snapshots.save_vectors(v1, root, "7", "2024-07-01 00:00:00")
    row = snapshots.load_vectors(spark, root, "007").first()
    assert (row["embedding"], row["model_id"], row["version"]) == ([2.0], "007", "20240602080000")
    with pytest.raises(LookupError, match="other"):
        snapshots.load_vectors(spark, root, "other")


def test_an_unlisted_version_is_not_loaded(spark, tmp_path):
    root = str(tmp_path / "store")
    v = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    version = snapshots.save_vectors(v, root, "m", "2024-05-13 20:45:46")
    v.write.parquet(f"{root}/vectors/model_id=m/version=20990101000000")
    assert snapshots.load_vectors(spark, root, "m").first()["version"] == version


def test_a_save_that_fails_leaves_the_version_as_it_was(spark, tmp_path):
    root = str(tmp_path / "store")
    v = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    snapshots.save_vectors(v, root, "m", "2024-05-13 20:45:46")
    broken = v.selectExpr("vec_id", "if(vec_id = 1, raise_error('lost'), embedding) AS embedding")
    with pytest.raises(Exception, match="lost"):
        snapshots.save_vectors(broken, root, "m", "2024-05-13 20:45:46")
    assert snapshots.load_vectors(spark, root, "m").first()["embedding"] == [1.0]
    snapshots.save_vectors(v.withColumn("vec_id", F.lit(2)), root, "m", "2024-05-13 20:45:46")
    assert snapshots.load_vectors(spark, root, "m").first()["vec_id"] == 2


def test_pages_are_files_of_one_directory(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a\n  {i}") for i in range(200)], "doc_id bigint, text string")
    context.write_pages(docs, str(tmp_path / "pages"), page_docs=10)
    files = list((tmp_path / "pages").glob("part-*"))
    assert len(files) == 20
    pages = context.read_pages(spark, str(tmp_path / "pages")).collect()
    assert {r["page"]: r["value"].strip("\n") for r in pages} == {
        p: "\n".join(f"a\n  {i}" for i in range(10 * p, 10 * p + 10)) for p in range(20)
    }


def test_context_of_all_documents(spark, tmp_path):
    texts = {i: f"{{\n  doc {i}\n}}" for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7)
    whole = "\n".join(f"{{{{doc {i}}}}}" for i in range(200))
    pages = context.context_pages(docs, page_docs=10).orderBy("page").collect()
    assert [p["docs"] for p in pages] == [10] * 20
    assert "\n".join(p["context"] for p in pages) == whole

    out = tmp_path / "context"
    context.write_context(docs, str(out))
    written = "".join(f.read_text() for f in sorted(out.glob("part-*")))
    assert written == whole + "\n"


def test_a_json_file_is_one_document(spark, tmp_path):
    body = json.dumps({"tables": [{"name": "sales"}]}, indent=4)
    (tmp_path / "schema.json").write_text(body)
    docs = landing.read_documents(spark, str(tmp_path / "schema.json"))
    assert [r["value"] for r in docs.collect()] == [body]
    flat = context.flatten_documents(docs, "value").first()["value"]
    assert flat == '{{"tables": [{{"name": "sales"}}]}}'


def test_search_saves_whole_versions(spark, monkeypatch):
    """The saves that must lose hold every vector, at another scale."""
    from workload.queries import QUERIES

    saved, save = [], snapshots.save_vectors

    def seen(vectors, *args):
        saved.append({r["vec_id"]: r["embedding"] for r in vectors.collect()})
        save(vectors, *args)

    monkeypatch.setattr(snapshots, "save_vectors", seen)
    QUERIES["embedding_search"](spark, "/root/testdata/sf0.001").collect()
    older, replaced, last = saved
    assert len(last) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert older.keys() == replaced.keys() == last.keys()
    assert all(older[i] != v and replaced[i] != v for i, v in last.items())


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_any_range_of_the_context(spark, tmp_path, chunk):
    """Whole, parts of characters, ranges beyond the end, repeated and empty documents, one id on a third of all rows."""
    rng = random.Random(chunk)
    texts = [(i if i % 3 else 9, rng.choice(["", "é" * 9, "a\n  b", "{日本}"]) + str(i)) for i in range(90)] + [(5, "twice"), (5, "twice"), (None, "no id"), (7, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    context.write_addressable(docs, str(tmp_path / "context"), chunk)
    places = context.document_places(docs).orderBy("begin").collect()
    assert [r["doc_id"] for r in places] == sorted((i for i, t in texts if t is not None), key=lambda i: (i is not None, i or 0))
    whole_size = places[-1]["begin"] + places[-1]["size"]
    asked = [(0, 0, whole_size + 50), (1, 5, 6), (2, 9, 9), (3, whole_size + 5, whole_size + 9)]
    asked += [(10 + k, a := rng.randint(0, whole_size), a + rng.randint(1, 200)) for k in range(20)]
    ranges = spark.createDataFrame(asked, "range_id bigint, begin bigint, stop bigint")
    found = {r["range_id"]: bytes(r["bytes"]) for r in context.read_ranges(spark, str(tmp_path / "context"), ranges, chunk).collect()}
    whole = found[0]
    assert len(whole) == whole_size
    flat = [r["text"] for r in context.flatten_documents(docs).collect() if r["text"] is not None]
    assert sorted(whole.decode().removesuffix("\n").split("\n")) == sorted(flat)
    assert {i: b for i, b in found.items() if b} == {i: whole[a:b] for i, a, b in asked if whole[a:b]}
    pages = context.context_pages(docs, page_docs=10).orderBy("page").collect()
    assert [p["docs"] for p in pages] == [10] * 9 + [3]
    assert "\n".join(p["context"] for p in pages) + "\n" == whole.decode()


def test_changes_to_versions(spark, tmp_path):
    """Added, replaced, removed, added again; read by version, folded, and changed after that."""
    root, schema = str(tmp_path / "store"), "vec_id bigint, embedding array<float>, label int"

    def some(**rows):
        return spark.createDataFrame([(int(k[1:]), [float(v)], v) for k, v in rows.items()], schema)

    def held(as_of=None):
        loaded = snapshots.load_vectors(spark, root, "m", as_of)
        assert loaded.columns == ["vec_id", "embedding", "label", "model_id", "version"]
        return {r["vec_id"]: r["label"] for r in loaded.collect()}

    none = some(v0=0).limit(0)
    snapshots.save_vectors(some(v1=1, v2=2, v3=3), root, "m", "2024-05-01 00:00:00")
    snapshots.save_vectors(some(v9=9), root, "other", "2024-06-01 00:00:00")
    snapshots.save_changes(some(v2=22, v4=4), some(v3=0, v8=0), root, "m", "2024-05-02 00:00:00")
    snapshots.save_changes(some(v3=33), some(v2=0), root, "m", "2024-05-03 00:00:00")
    snapshots.save_changes(some(v2=222, v1=11), some(v1=0), root, "m", "2024-05-03 00:00:00")  # the same version once more
    latest = {1: 11, 2: 222, 3: 33, 4: 4}
    assert held("2024-05-01 12:00:00") == {1: 1, 2: 2, 3: 3}
    assert held("2024-05-02 00:00:00") == {1: 1, 2: 22, 4: 4}
    assert held() == latest
    assert snapshots.fold_vectors(spark, root, "m") == "20240503000000"
    assert held() == latest and held("2024-05-02 00:00:00") == {1: 1, 2: 22, 4: 4}
    snapshots.save_changes(none, some(v1=0, v2=0, v3=0, v4=0), root, "m", "2024-05-04 00:00:00")
    assert held() == {}
    assert snapshots.fold_vectors(spark, root, "m") == "20240504000000"
    assert held() == {} and held("2024-05-03 00:00:00") == latest
    snapshots.save_changes(some(v5=5), none, root, "m", "2024-05-05 00:00:00")
    assert held() == {5: 5}


def test_changes_that_fail_are_not_listed(spark, tmp_path):
    root = str(tmp_path / "store")
    v = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    snapshots.save_vectors(v, root, "m", "2024-05-13 20:45:46")
    broken = v.selectExpr("vec_id", "if(vec_id = 1, raise_error('lost'), embedding) AS embedding")
    with pytest.raises(Exception, match="lost"):
        snapshots.save_changes(broken, v, root, "m", "2024-05-14 00:00:00")
    assert [r["vec_id"] for r in snapshots.load_vectors(spark, root, "m").collect()] == [1]
