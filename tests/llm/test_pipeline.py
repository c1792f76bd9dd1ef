"""Stages of the pipeline, each held against brute force on what the one before has kept."""

import zlib

import numpy as np

import corpus_pipeline
from tallyhouse.llm.word_tokens import encoder, vocabulary_path
from tallyhouse.session import stored
from tests.llm.test_dedup import lowered, near, removed, removed_words

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("toxic = 0").collect()}
    left = {r["doc_id"]: r["text"] for r in kept["toxicity"]}
    assert len(toxic & set(left)) <= 0.5 * len(toxic)
    assert clean <= set(left)

    best = {}
    for i, t in left.items():
        best[lowered(t)] = max(i, best.get(lowered(t), i))
    distinct = {r["doc_id"]: r["text"] for r in kept["exact_dedup"]}
    assert set(distinct) == set(best.values())

    rows = sorted(distinct.items())
    assert {r["doc_id"] for r in kept["minhash_dedup"]} == {i for i, _, _, stays in near(rows, 5, 80) if stays}

    texts = [r["text"].encode() for r in kept["minhash_dedup"]]
    cut = {r["doc_id"]: r for r in kept["suffix_dedup"]}
    assert len(cut) == len(texts)
    for r, t, gone, also in zip(kept["minhash_dedup"], texts, removed(texts, 400), removed_words(texts, 51), strict=True):
        own = cut[r["doc_id"]]
        assert own["text"] == np.frombuffer(t, np.uint8)[~(gone | also)].tobytes().decode(errors="ignore")
        assert (own["lang"], own["n_chars"]) == (r["lang"], len(own["text"]))

    ids = encoder(vocabulary_path()).library
    for r in kept["packing"]:
        whole = np.array([*ids.encode(cut[r["doc_id"]]["text"], add_special_tokens=False).ids, 1], "<u4")
        assert r["doc_tokens"] == len(whole)
        assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in kept["packing"] if r["start"] + r["length"]) == sum(r["doc_tokens"] for r in kept["packing"] if r["start"] == 0)


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), name)
    assert docs.count() == 0


def test_passage_of_short_words(spark):
    """A passage of 51 words goes although it has far less than 400 bytes; one of 50 stays."""
    long, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 51), ("b", 50)))
    rows = [(k, f"text own{k} {long} own{k} {short} own{k} end", "en", "web", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(long) < 400
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, docs, SF_DIR).collect()}
    assert found == {k: f"text own{k}  own{k} {short} own{k} end" for k in range(3)}
