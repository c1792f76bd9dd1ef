"""Encoding, packing and training order against the libraries and exact round trips."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyhouse.llm import byte_bpe, packing, token_shards, units, word_tokens
from tallyhouse.session import fresh_dir

SIGNS = "ab'stmdrevl  \n\t,.1½éÀ\x1c\x85"


def odd_texts(more="", n=400):
    rng = random.Random(4)
    return ["".join(rng.choices(SIGNS + more, k=rng.randint(0, 40))) for _ in range(n)]


def test_byte_ids_are_those_of_the_library(awkward):
    import public_tokenizers
    import tiktoken

    own = byte_bpe.encoder(byte_bpe.vocabulary_path())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.merges.ranks, special_tokens={})
    texts = [t or "" for _, t in awkward] + odd_texts() + odd_texts(" 　日本ж١🎉")
    packed = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(packed) == [t.encode() for t in texts]


def test_texts_are_cut_where_no_match_reaches_across(monkeypatch):
    own = byte_bpe.encoder(byte_bpe.vocabulary_path())
    texts = [" ".join(odd_texts(n=40)), "x" * 300 + "   y" * 50]
    whole = own.encode(texts)
    monkeypatch.setattr(byte_bpe, "CHUNK", 50)
    assert own.encode(texts) == whole


def test_memory_begins_again_when_full(monkeypatch):
    own = byte_bpe.ByteEncoder(byte_bpe.vocabulary_path())
    texts = odd_texts()
    whole = [own.encode([t])[0] for t in texts]
    own.memory.most = 50
    own.memory._forget()
    assert [own.encode([t])[0] for t in texts] == whole


def test_encoding_and_decoding_hold_little_at_a_time(monkeypatch):
    """What a worker holds depends neither on how much text it is given at once nor on how many matches it has seen."""

    def peak(of, given):
        tracemalloc.start()
        try:
            return of(given), tracemalloc.get_traced_memory()[1] / 2**20
        finally:
            tracemalloc.stop()

    own = byte_bpe.ByteEncoder(byte_bpe.vocabulary_path())
    text = " ".join(f"q{n:05x}" for n in range(80_000)) + " the end" * 200_000
    packed, held = peak(own.encode, [text])
    assert held < 60  # MB; was 113
    assert sum(x.nbytes for x in (own.memory.hashes, own.memory.offsets, own.memory.sizes)) < 16 << 20  # was 40 MB, room for the most that is remembered
    monkeypatch.setattr(byte_bpe, "_encoders", {})
    monkeypatch.setattr(byte_bpe, "_decoders", {})
    back, held = peak(byte_bpe.decoder(byte_bpe.vocabulary_path()).decode, packed)
    assert back == [text.encode()] and not byte_bpe._encoders
    assert held < 20  # MB; was 46


def test_byte_bpe_frames(documents, awkward):
    encoded = byte_bpe.encode(documents(awkward))
    found = byte_bpe.decode(encoded).collect()
    assert sorted(((r["doc_id"], bytes(r["bytes"])) for r in found), key=repr) == sorted(
        ((i, (t or "").encode()) for i, t in awkward), key=repr
    )
    assert byte_bpe.decode(byte_bpe.encode(documents([]))).count() == 0


def library_ids(texts):
    tokenizer = Tokenizer.from_file(word_tokens.vocabulary_path())  # as it comes, special spellings are ids of their own
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_are_those_of_the_library(awkward, monkeypatch):
    texts = [t or "" for _, t in awkward] + odd_texts() + odd_texts(" 日本ж١")
    own = word_tokens.encoder(word_tokens.vocabulary_path())
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)] == library_ids(texts)
    monkeypatch.setattr(word_tokens, "CHUNK", 30)
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)] == library_ids(texts)


@pytest.mark.parametrize("bits,dimensions", [(3, 2), (2, 3)])
def test_curve_visits_every_cell_by_single_steps(bits, dimensions):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing(documents, awkward):
    pieces = packing.pack(documents(awkward), length=64).collect()
    place = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in pieces)
    ends = np.cumsum([n for _, n in place])
    assert [at for at, _ in place] == [0, *ends[:-1].tolist()]  # one stream without gaps: only the last sequence is short
    assert all(r["offset"] + r["length"] <= 64 for r in pieces)
    texts = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"]
        if r["start"] == 0:
            texts.setdefault(r["doc_id"], []).append([])
        assert len(texts[r["doc_id"]][-1]) == r["start"]
        texts[r["doc_id"]][-1] += ids
    expected = {}
    for (i, _), ids in zip(awkward, library_ids([t or "" for _, t in awkward]), strict=True):
        expected.setdefault(i, []).append([*ids, packing.END])
    assert {i: sorted(x) for i, x in texts.items()} == {i: sorted(x) for i, x in expected.items()}
    assert packing.pack(documents([])).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation(count):
    found = token_shards.slots(np.arange(count), count, 5)
    assert sorted(found.tolist()) == list(range(count))
    assert count < 10 or found.tolist() != list(range(count))


def test_shards(spark, documents, awkward):
    df, folder = documents(awkward).coalesce(2), fresh_dir(spark, "shards")
    index = token_shards.write_shards(df, folder, length=16, shard_sequences=10)
    rows = index.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["shard"] == r["slot"] // 10 and r["offset"] == r["slot"] % 10 * 32 for r in rows)
    held = {r["slot"]: np.frombuffer(bytes(r["ids"]), "<u2") for r in token_shards.read_shards(spark, index, folder, 16).collect()}
    flat = np.concatenate([held[r["slot"]][: r["n_tokens"]] for r in sorted(rows, key=lambda r: r["sequence"])])
    expected = sorted([*ids, token_shards.END] for ids in library_ids([t or "" for _, t in awkward]))
    ends = np.flatnonzero(flat == token_shards.END)
    assert sorted(x.tolist() for x in np.split(flat, ends + 1)[:-1]) == expected
    later = token_shards.read_shards(spark, index, folder, 16, begin=13).agg(F.min("slot"), F.count("slot")).first()
    assert tuple(later) == (13, len(rows) - 13)
    assert token_shards.training_order(documents([])).count() == 0


def test_known_matches_are_found_without_sorting_them(monkeypatch):
    """Known matches come from a table; those that share an entry of it are still told apart, also after a new beginning."""
    learned = []

    monkeypatch.setattr(units, "_TABLE_BITS", 6)
    monkeypatch.setattr(units, "_LEADING", np.uint64(58))
    memory = units.Memory(None, join_space=False, dtype=np.int64, most=600)
    numbers = np.random.default_rng(3).integers(0, 10, 500)
    words = [chr(97 + n).encode() * (i % 50 + 1) for i, n in enumerate(numbers.tolist())]
    memory.learn = lambda matches: (learned.extend(matches), (np.array([len(m) * 256 + m[0] for m in matches]), np.ones(len(matches), int)))[1]
    texts = [b" ".join(words[a : a + 50]) for a in range(0, 500, 50)]
    expected = [len(w) * 256 + w[0] for w in words]
    for _ in range(2):
        flat, sizes = memory.encode(texts)
        assert flat.tolist() == expected and sizes.tolist() == [50] * 10
    assert len(learned) == len(set(words))
    place, missed = memory._guess(memory.hashes[: memory.known])
    entries = set((memory.hashes[: memory.known] >> np.uint64(58)).tolist())
    assert memory.known == len(set(words)) and len(place) - len(missed) == len(entries) < memory.known
    memory.most = memory.known
    assert memory.encode([b"zzz zzzz a", texts[0]])[0].tolist() == [3 * 256 + 122, 4 * 256 + 122, 256 + 97, *expected[:50]]
