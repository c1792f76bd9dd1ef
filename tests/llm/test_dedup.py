"""Exact, near and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyhouse.llm import minhash_dedup as minhash
from tallyhouse.llm import quotient_filter as qf
from tallyhouse.llm.components import components
from tallyhouse.llm.exact_dedup import exact_dedup
from tallyhouse.llm.suffix_dedup import suffix_dedup
from tallyhouse.llm.union import join_groups


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 2**63, 500, dtype=np.uint64) << np.uint64(1) for _ in range(4)]
    parts.append(np.concatenate(parts[:2]))
    filters = defaultdict(list)
    for p in parts:
        for block, packed in qf.blocks(p, 5):
            filters[block].append(packed)
    found = Counter()
    for block, packed in filters.items():
        prints, counts = qf.merged(block, packed, 5)
        assert (np.diff(prints.astype(object)) > 0).all()
        found.update(dict(zip(prints.tolist(), counts.tolist(), strict=True)))
    assert found == Counter(np.concatenate(parts).tolist())


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact(documents, awkward):
    groups = defaultdict(list)
    for i, t in awkward:
        groups[lowered(t)].append(i)
    expected = []
    for i, t in awkward:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    assert by_id(exact_dedup(documents(awkward))) == sorted(expected, key=repr)
    assert exact_dedup(documents([])).count() == 0


def removed(texts, window):
    seen = Counter(t[s : s + window] for t in texts for s in range(len(t) - window + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - window + 1):
            if seen[t[s : s + window]] > 1:
                gone[s : s + window] = True
        yield gone


def check_suffix(documents, rows, window):
    texts = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), t, gone in zip(rows, texts, removed(texts, window), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        expected.append((i, len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    found = suffix_dedup(documents(rows), window=window).collect()
    ours = [(r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in found]
    assert sorted(ours, key=repr) == sorted(expected, key=repr)


def test_suffix_on_awkward_texts(documents, awkward):
    check_suffix(documents, [(i, t and t[:3000]) for i, t in awkward], 40)


def test_suffix_on_shared_passages(documents):
    rng = random.Random(5)
    passages = ["".join(rng.choices("abcd ", k=rng.randint(10, 90))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("abcd éß", k=rng.randint(1, 60))) for _ in range(6)]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # a crowd of copies
    check_suffix(documents, rows, 40)


def test_suffix_in_pieces_of_long_texts(documents, monkeypatch):
    from tallyhouse.llm import suffix_dedup as module

    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=9000))
    batch = next(iter([long.encode()]))
    powers = module._powers(len(batch) + 1)
    whole = module.bundles(batch, np.zeros(0, int), 40, powers)
    windows = {(s, int(p)) for a, b, p in zip(*whole, strict=True) for s in range(a, b + 1)}
    for at in range(0, 9000, 1000):  # the choice of an anchor depends on the window alone
        piece = batch[at : at + 1039]
        for a, b, p in zip(*module.bundles(piece, np.zeros(0, int), 40, powers), strict=True):
            assert all((s + at, int(p) + at) in windows for s in range(a, b + 1))


def removed_words(texts, words):
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    windows = [[(w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1)] for w in places]
    seen = Counter(t[a:z] for t, own in zip(texts, windows, strict=True) for a, z in own)
    for t, own in zip(texts, windows, strict=True):
        gone = np.zeros(len(t), bool)
        for a, z in own:
            if seen[t[a:z]] > 1:
                gone[a:z] = True
        yield gone


def test_suffix_by_words(documents, awkward, monkeypatch):
    """Words and bytes together, long texts in pieces."""
    from tallyhouse.llm import suffix_dedup as module

    monkeypatch.setattr(module, "CHUNK", 1 << 12)
    rng = random.Random(8)
    passages = [rng.choice(" \n").join(rng.choices(["a", "bé", "cat", "\u00a0d"], k=rng.randint(3, 25))) for _ in range(12)]
    rows = [(i, t and t[:9000]) for i, t in awkward]
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("abcd é\t", k=rng.randint(1, 60))) for _ in range(6)]
        rows.append((100 + i, " ".join(parts)))
    rows += [(300 + i, rows[20][1]) for i in range(30)]
    texts = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), t, gone, also in zip(rows, texts, removed(texts, 60), removed_words(texts, 7), strict=True):
        expected.append((i, int((gone | also).sum()), np.frombuffer(t, np.uint8)[~(gone | also)].tobytes()))
    found = [(r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup(documents(rows), window=60, words=7).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_suffix_text_and_empty_table(documents):
    text = "é" * 30 + "tail"
    found = suffix_dedup(documents([(1, text), (2, "é" * 30)], lang="fr"), window=41, as_text=True, carry=("lang",))
    assert {(r["doc_id"], r["kept"], r["lang"]) for r in found.collect()} == {(1, "tail", "fr"), (2, "", "fr")}
    assert suffix_dedup(documents([])).count() == 0


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if len(words) >= width:
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def near(rows, width, percent):
    """Components by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = np.arange(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                join_groups(root, np.array([a]), np.array([b]))
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(root == root[k]) if rows[j][0] is not None]
        component = min(ids, default=None) if sets[k] else i
        yield i, len(sets[k]), component, i == component


def test_near_on_awkward_texts(documents, awkward):
    for width, percent in ((3, 85), (5, 80)):
        assert by_id(minhash.minhash_dedup(documents(awkward), width, percent)) == sorted(near(awkward, width, percent), key=repr)
    assert minhash.minhash_dedup(documents([])).count() == 0


def test_near_in_a_crowd(documents, monkeypatch):
    """Copies with few to many changes; a region larger than a task compares, in tiles."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 12)):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(rng.choices([f"v{j}" for j in range(50)], k=rng.randint(1, 9)))) for i in range(150)]
    assert by_id(minhash.minhash_dedup(documents(rows), 3, 85)) == sorted(near(rows, 3, 85), key=repr)


def test_near_to_a_crowd_only(documents):
    """Pages of a template that differ in a field, and one that lacks a part of it: near all the others, but only by what all share."""
    rows = []
    for template, lacking in ((11, 70), (17, 270)):  # two that a longer prefix in a crowd would lose
        base = [f"t{template}w{i}" for i in range(400)]
        pages = [base[:200] + [f"f{i}x{j}" for j in range(4)] + base[204:] for i in range(300)]
        short = base[:200] + [f"gx{j}" for j in range(4)] + base[204:]
        pages.append(short[:lacking] + short[lacking + 57 :])
        rows += [(1000 * template + i, " ".join(words)) for i, words in enumerate(pages)]
    expected = sorted(near(rows, 5, 80), key=repr)
    assert {c for _, _, c, _ in expected} == {11_000, 17_000}
    assert by_id(minhash.minhash_dedup(documents(rows), 5, 80)) == expected


def test_pages_with_much_text_in_common_part(documents, monkeypatch):
    """No two of them are near, though neighbours by minhash; among them are families of near copies. Few sets are held together."""
    monkeypatch.setattr(minhash, "BLOCK", 32)
    rng = random.Random(9)
    shared, rows = [f"s{i}" for i in range(60)], []
    for i in range(400):
        words = shared + [f"p{i}w{j}" for j in range(rng.randint(14, 50))]  # up to some four fifths in common
        rows.append((1000 + i, " ".join(words)))
        if i % 20 == 0:
            for k in range(1, 4):
                rows.append((5000 + 10 * i + k, " ".join([*words[:-1], f"x{i}k{k}"])))
    compared, compare = [], minhash.neighbourhoods

    def seen(members, sets, percent):
        compared.append(members.groupBy("region").count().collect())
        out = compare(members, sets, percent)
        compared.append(out.groupBy("region").count().collect())
        return out

    monkeypatch.setattr(minhash, "neighbourhoods", seen)
    expected = sorted(near(rows, 5, 80), key=repr)
    assert by_id(minhash.minhash_dedup(documents(rows), 5, 80)) == expected
    first, last = ([r["count"] for r in sizes] for sizes in compared)
    assert max(first) > 300
    assert sum(n * n for n in last) < 0.1 * sum(n * n for n in first)


def test_rare_shingles_lose_no_pair():
    """Whatever is taken for common, sets at the threshold share one of the first shingles."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        percent = int(rng.integers(50, 100))
        pool = np.unique(rng.integers(0, 400, 300).astype(np.uint64))
        a = np.unique(rng.choice(pool, rng.integers(1, 120)))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(1, len(a) + 1)), rng.choice(pool, rng.integers(0, 9))]))
        common = np.unique(rng.choice(pool, 100))
        counts = rng.integers(2, 60, len(common))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(minhash.rare_first(a, common, counts, percent), minhash.rare_first(b, common, counts, percent)))


def test_long_words_are_told_apart(documents):
    """A word of 2,048 letters and its complement, which running sums of powers take for equal."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"one {word} two"), (4, f"one {other} two"), (5, word.upper())]
    assert by_id(minhash.minhash_dedup(documents(rows), 3, 85)) == sorted(near(rows, 3, 85), key=repr)


def test_prefix_length_follows_the_threshold():
    assert minhash.first_depth(0.85) > minhash.first_depth(0.8) > minhash.first_depth(0.5) >= 1
    assert (1 - 0.85 ** minhash.first_depth(0.85)) ** minhash.TREES <= minhash.LOST


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(60)],
        "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)],
        "none": [],
    }[shape]
    root = np.arange(600)
    if links:
        join_groups(root, *map(np.array, zip(*links, strict=True)))
    linked = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in found) == [(x, root[x]) for x in sorted(linked)]
