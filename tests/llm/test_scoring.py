"""Toxicity, quality, embeddings and archives on small inputs."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import quality as q
from tallyhouse.llm import toxicity as tox
from tallyhouse.llm import warc
from tallyhouse.llm.embedding_dedup import embedding_dedup, near_pairs

SF_DIR = "/root/testdata/sf0.01"


def read(spark, name, sf_dir=SF_DIR):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_toxicity_on_held_out_labels(spark):
    scored = tox.toxicity(read(spark, "documents"), read(spark, "labels"))
    rows = scored.join(read(spark, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) >= 0.95
    assert np.mean([r["predicted"] for r in held if r["toxic"]]) >= 0.6
    assert np.mean([r["predicted"] for r in held if not r["toxic"]]) <= 0.02


def test_factors_learn_a_pair_that_weights_cannot():
    """Label 1 only where both of two terms are, or neither: no sum of weights gives that."""
    settings = tox.Settings(steps=3000)
    documents, marks = [], []
    for i in range(200):
        a, b = i % 2, i // 2 % 2
        own = [k for k, has in enumerate((a, b)) if has] + [2]
        documents.append((np.array(own), np.ones(len(own))))
        marks.append(float(a == b))
    model = tox.fit(np.arange(3), documents, np.array(marks), settings)
    for (rows, values), mark in zip(documents[:4], marks[:4], strict=True):
        raw = tox._raw(model, rows, values, np.array([0]))[0]
        assert (raw[0] > 0) == bool(mark)


def test_toxicity_edges(spark, documents, awkward):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (6, 0), (7, 1)], "doc_id long, toxic int")
    found = tox.toxicity(documents(awkward), labels).collect()
    assert len(found) == len(awkward)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    no_labels = tox.toxicity(documents(awkward), labels.limit(0)).collect()
    assert {r["score"] for r in no_labels} == {0.0}
    assert tox.toxicity(documents([]), labels).count() == 0


def kneser_ney(texts):
    """Probabilities by the textbook, one n-gram at a time."""
    tables = {q.ORDER: Counter(g for t in texts for g in grams(t))}
    for n in range(q.ORDER - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def discounts(table):
        n = [sum(c == k for c in table.values()) for k in range(5)]
        out = []
        for k in (1, 2, 3):
            d = k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k] if n[1] and n[k] else -1
            out.append(d if 0 <= d <= k else 0.5 * k)
        return out

    taken = {n: discounts(t) for n, t in tables.items()}
    letters = len(tables[1])

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (letters + 1)
        table, d = tables[len(g)], taken[len(g)]
        after = [c for h, c in table.items() if h[:-1] == g[:-1]]
        if not after:
            return lower
        of = lambda c: d[min(c, 3) - 1]
        own = max(table[g] - of(table[g]), 0) if table[g] else 0
        return (own + sum(map(of, after)) * lower) / sum(after)

    return p


def grams(text):
    plain = "\0" * (q.ORDER - 1) + " ".join(text.split())
    return [plain[i : i + q.ORDER] for i in range(len(plain) - q.ORDER + 1)]


def test_perplexity_is_that_of_the_textbook(spark):
    rng = random.Random(7)
    ids = defaultdict(list)
    for i in range(400):
        ids[zlib.crc32(str(i).encode()) % 5].append(i)
    rows = [(i, "x", "".join(rng.choices("abcde  ", k=rng.randint(0, 50)))) for fold in ids.values() for i in fold[:8]]
    rows += [(1000, "x", "zz top 日本"), (1001, "y", "abc"), (1002, None, "abc"), (None, "x", "abc"), (1003, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({"part": F.lit(1), "gram": F.lit(2)})
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows if i is not None and i < 1000] + [(None, 1)], "doc_id long, quality int")
    found = {(r["doc_id"], r["lang"]): r for r in q.quality(docs.repartition(3), labels).collect()}
    p = kneser_ney([" ".join(t.split()) for i, lang, t in rows if lang == "x" and i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 5 in q.LEARN])
    for i, lang, text in rows:
        own = grams(text or "")
        r = found[i, lang]
        if lang != "x" or not own:
            assert r["perplexity"] is None
            assert r["kept"] == bool(own)
        else:
            expected = math.exp(-sum(math.log(p(g)) for g in own) / len(own))
            assert r["perplexity"] == pytest.approx(expected, rel=1e-9)
            assert r["kept"] == (r["lower"] <= expected <= r["upper"])


def test_quality_keeps_the_clean_and_finds_junk(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = q.quality(read(spark, "documents", sf_dir), read(spark, "labels", sf_dir)).join(read(spark, "labels", sf_dir), "doc_id")
    held = [r for r in rows.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]  # neither learned from nor used for limits
    assert np.mean([r["kept"] for r in held if r["quality"] == 1]) >= 0.985
    assert np.mean([not r["kept"] for r in held if r["quality"] == 0]) >= 0.6


def test_quality_of_nothing(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert q.quality(documents([], lang="en"), labels).count() == 0


def test_no_pair_at_the_threshold_is_given_up():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 48)) * np.linspace(3, 0.1, 48)
    x[150:] = x[:150] + rng.normal(size=(150, 48)) * rng.uniform(0, 1, (150, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, cosine = near_pairs(x, x, 0.9)
    got = {(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), cosine, strict=True) if c >= 0.9}
    full = x @ x.T
    assert set(got) == set(zip(*(k.tolist() for k in np.nonzero(full >= 0.9)), strict=True))


def test_embeddings(spark, monkeypatch):
    from tallyhouse.llm import embedding_dedup as module

    rng = np.random.default_rng(2)
    centers = rng.normal(size=(25, 12))
    vectors = [list(map(float, centers[k % 25] + rng.normal(size=12) * (0.1 + k % 7 / 10))) for k in range(300)]
    rows = list(enumerate(vectors))
    rows += [(400 + k, vectors[0]) for k in range(40)]  # a crowd of copies
    rows += [(500, [2 * x for x in vectors[1]]), (501, None), (502, [0.0] * 12), (503, [float("nan")] * 12), (504, [])]
    rows += [(505, [None] * 12), (506, [1.0] * 3), (507, [2.0] * 3), (None, vectors[0]), (508, [1e300] * 12), (508, [1e300] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"class": F.lit(1), "tile": F.lit(2)})
    usable = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    near = defaultdict(set)
    for a in usable:
        for b in usable:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and len(x) == len(y) and (x / np.abs(x).max()) @ (y / np.abs(y).max()) >= 0.9 * np.linalg.norm(x / np.abs(x).max()) * np.linalg.norm(y / np.abs(y).max()):
                near[a].add(b)
    expected = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        component = min(rows[x][0] for x in seen if rows[x][0] is not None) if i is not None else None
        expected.append((i, len(near[k]), component, i is not None and i == component))
    for tile in (4096, 50):
        monkeypatch.setattr(module, "TILE", tile)
        found = [tuple(r) for r in embedding_dedup(df.repartition(3)).collect()]
        assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert embedding_dedup(df.limit(0)).count() == 0


def test_archives(spark):
    rows = [(k, f"http://x/{k} a\r\nb", f"<p>{'text ' * (k % 50)}{k % 17}</p>") for k in range(200)]
    rows += [(None, None, rows[5][2]), (300, None, None), (301, "u", ""), (302, "ü", "日本🎉\r\n\r\nWARC/1.1"), (302, "ü", "日本🎉\r\n\r\nWARC/1.1"), (None, None, "only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "archive": F.lit(2)})
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    expected = []
    for i, _, html in rows:
        target = first.get(html or "")
        target = None if i == target else target
        expected.append((i, len((html or "").encode()), "revisit" if target is not None else "response", target))
    found = warc.warc_round_trip(df.coalesce(2), archive_bytes=10_000).collect()
    assert sorted(((r["id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found), key=repr) == sorted(expected, key=repr)
    assert len({r["archive"] for r in found}) > 1
    large = warc.warc_round_trip(df, revisit_from=1000).collect()
    assert {r["record_type"] for r in large} == {"response"}
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_an_archive_is_read_back_byte_by_byte():
    import struct

    import zstandard

    records = [warc.record(k, f"http://x/{k}", f"payload {k % 9} ".encode() * 40, None, False, "1970-01-01T00:00:00Z") for k in range(400)]
    data, dictionary = warc.archive(records, 4096, 3)
    assert dictionary and struct.unpack_from("<II", data) == (warc.DICTIONARY_FRAME, dictionary)
    blocks = [block for _, block in warc.records_of(data)]
    assert [b.partition(b"\r\n\r\n")[2] for b in blocks] == [f"payload {k % 9} ".encode() * 40 for k in range(400)]
    at = 8 + dictionary  # each record is a frame of its own
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:at])).decompressobj()
    assert unpack.decompress(data[at:]) == records[0]
