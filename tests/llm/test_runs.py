"""Periodic runs against brute force, and the registered query against its contract."""

import hashlib
import random
import re
import zlib

import pytest

import __spark_entry__ as driver
from tallyhouse.llm.periodic_runs import periodic_runs, runs

SF_DIR = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every period in turn: stretches of words equal to those a period on, kept if no lesser period fits."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            if len(stretch) >= max(least, 2 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                out.append((start, len(stretch), q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_text(rng):
    letters = "abcde"[: rng.choice([1, 2, 3, 5])]
    words = []
    for _ in range(rng.randint(0, 9)):
        if rng.random() < 0.6:
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            words += (unit * rng.randint(1, 7))[: -rng.randint(1, len(unit))]
        else:
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))]
    return words


@pytest.mark.parametrize("least", [2, 5, 12, 13])
def test_runs_of_few_words(least):
    rng = random.Random(least)
    for _ in range(600):
        words = some_text(rng)
        assert runs([w.encode() for w in words], least) == brute(words, least)


@pytest.mark.parametrize("shape", ["one word", "long period", "fibonacci", "two words"])
def test_long_texts_in_one_go(shape):
    """Crowded intervals: their work must not grow with the square of the text."""
    n, rng = 200_000, random.Random(1)
    a, b = b"a", b"ab"
    while len(b) < n:
        a, b = b, b + a
    words = {
        "one word": [b"a"] * n,
        "long period": [b"%d" % (i % 1000) for i in range(n)],
        "fibonacci": [bytes([c]) for c in b[:n]],
        "two words": rng.choices([b"a", b"b"], k=n),
    }[shape]
    found = runs(words)
    if shape in ("one word", "long period"):
        assert found == [(0, n, 1 if shape == "one word" else 1000)]
    else:
        assert all(words[s : s + k - q] == words[s + q : s + k] for s, k, q in found[:200])
        assert runs(words[:300]) == brute(words[:300])


def test_awkward_texts(documents, awkward):
    rng = random.Random(4)
    rows = [*awkward, *((100 + i, " \n".join(some_text(rng))) for i in range(60)), (200, "la " * 50_000), (201, "x y " * 12)]
    rows += rows[-3:]
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(documents(rows)).collect()]
    expected = []
    for i, text in rows:
        words = words_of(text)
        own = [(0, 50_000, 1)] if i == 200 else [] if i == 8 else brute(words)
        expected.append((i, len(words), own, kept(words, own)))
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert periodic_runs(documents([])).count() == 0


def test_registered_query(spark):
    expected = {}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        words, h = words_of(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute(words) if n < 1500 else runs([w.encode() for w in words])
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        expected[r["doc_id"]] = (
            len(found), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept(words, found).encode()).hexdigest(),
        )
    rows = driver.queries()["op13_periodic_runs"](spark, SF_DIR)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r[1:]) for r in rows.collect()} == expected
    assert sum(x[0] > 0 for x in expected.values()) > 10
