"""The registered queries that no SQL covers, as they are registered, against the libraries and brute force."""

import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as driver
from tallyhouse.llm import byte_bpe, word_tokens
from tests.llm.test_dedup import removed

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def answer(spark, name, columns, sf_dir=SF_DIR):
    frame = driver.queries()[name](spark, sf_dir)
    assert frame.columns[: len(columns)] == columns
    return frame.collect()


def test_op1(spark, texts):
    data = {i: t.encode() for i, t in texts.items()}
    expected = {}
    for (i, t), gone in zip(data.items(), removed(list(data.values()), 400), strict=True):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace"))
    rows = answer(spark, "op1_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert {r[0]: tuple(r)[1:5] for r in rows} == {i: x[:4] for i, x in expected.items()}
    assert all(r["text"] == expected[r["doc_id"]][4] for r in rows if "�" not in r["text"])
    assert sum(x[1] > 0 for x in expected.values()) > 10


def test_op2(spark):
    """On the larger tables, as the smallest have some ten toxic documents to learn from."""
    sf_dir = "/root/testdata/sf0.01"
    rows = answer(spark, "op2_toxicity", ["doc_id", "held_out", "score", "predicted"], sf_dir)
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "labels"))
    assert {r["doc_id"]: r["held_out"] for r in rows} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in documents}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    marks = {r["doc_id"]: r["toxic"] for r in labels}
    scores = {r["doc_id"]: r["score"] for r in rows}
    toxic, clean = ([scores[i] for i, mark in marks.items() if mark == want and i in scores] for want in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9


def test_op4(spark, texts):
    library = Tokenizer.from_file(word_tokens.vocabulary_path())
    rows = answer(spark, "op4_packing", ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    for r in rows:
        whole = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(whole) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
    own = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert own.get(r["doc_id"], 0) == r["start"]
        own[r["doc_id"]] = r["start"] + r["length"]
    assert own == {i: len(x) for i, x in ids.items()}
    held = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert held.get(r["sequence_id"], 0) == r["offset"]
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(held) == list(range(len(held)))
    assert all(n == 2048 for k, n in held.items() if k < len(held) - 1) and max(held.values()) <= 2048


def test_op5(spark, texts):
    import base64

    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(byte_bpe.vocabulary_path(), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for i, t in texts.items():
        ids = np.array(library.encode_ordinary(t), "<u4")
        expected[i] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    rows = answer(spark, "op5_byte_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == expected


def test_op9(spark, texts):
    rows = answer(spark, "op9_quality", ["doc_id", "lang", "perplexity", "lower", "upper", "kept"])
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["perplexity"] is None or r["perplexity"] > 1 for r in rows)
    inside = [r["lower"] is None or r["perplexity"] is None or r["lower"] <= r["perplexity"] <= r["upper"] for r in rows]
    assert [r["kept"] for r in rows] == [bool(texts[r["doc_id"]]) and fits for r, fits in zip(rows, inside, strict=True)]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality = 1").collect()}
    assert np.mean([r["kept"] for r in rows if r["doc_id"] in good]) > 0.95


def test_op10(spark, texts):
    rows = answer(spark, "op10_token_shards", ["slot", "shard", "offset", "sequence", "n_tokens", "doc_ids", "crc32", "read_crc32"])
    assert sorted(r["slot"] for r in rows) == sorted(r["sequence"] for r in rows) == list(range(len(rows)))
    assert all(r["crc32"] == r["read_crc32"] for r in rows)
    library = Tokenizer.from_file(word_tokens.vocabulary_path())
    assert sum(r["n_tokens"] for r in rows) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert {i for r in rows for i in r["doc_ids"]} == set(texts)
