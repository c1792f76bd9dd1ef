"""Two tokenizers aligned, against both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as driver
from tallyhouse.llm import alignment
from tallyhouse.llm.perfect_hash import build, numbers, verified

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash(n, monkeypatch):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    strange = keys + np.uint64(1 << 63)
    for levels in (40, 2):  # with few levels some keys are kept as they are
        monkeypatch.setattr("tallyhouse.llm.perfect_hash.LEVELS", levels)
        function = build(keys)
        at = numbers(function, keys)
        assert sorted(at.tolist()) == list(range(len(keys)))
        kept = np.empty_like(keys)
        kept[at] = keys
        assert (verified(function, kept, keys) == at).all()
        assert (verified(function, kept, strange) == -1).all()
    assert levels == 2 and (n < 100 or len(build(keys)) < 8 * n + 8 * n)


class Libraries:
    def __init__(self):
        a_path, b_path = alignment.vocabulary_paths()
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        signs = {v: k for k, v in alignment._byte_of_sign().items()}
        assert len(set(signs.values())) == 256

    def tokens(self, text):
        """((id, bytes) of A, (id, bytes) of B), both empty if a text does not join to itself."""
        if not text:
            return [], []
        signs = alignment._byte_of_sign()
        a = [(i, bytes(signs[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def expected_rows(rows):
    libraries, cut, total = Libraries(), [], Counter()
    for i, text in rows:
        a, b = libraries.tokens(text)
        groups, links, x, y, a_end, b_end, own = [], [], 0, 0, 0, 0, ([], [])
        while x < len(a) or y < len(b):  # whichever is behind takes its next token
            if a_end <= b_end and x < len(a) and not (a_end == b_end and own[0]):
                own[0].append(a[x][0])
                a_end += len(a[x][1])
                x += 1
            else:
                own[1].append(b[y][0])
                b_end += len(b[y][1])
                y += 1
            if a_end == b_end and own[0] and own[1]:
                groups.append("|".join(",".join(map(str, ids)) for ids in own))
                links.append((own[0][-1], own[1][-1]))
                own = ([], [])
        total.update(links)
        cut.append((i, len(a), len(b), groups, links))
    highest = Counter()
    for (_, b), n in total.items():
        highest[b] = max(highest[b], n)
    return total, highest, [
        (i, na, nb, len(groups), len(links), sum(total[x] == highest[x[1]] for x in links), sum(total[x] for x in links), ";".join(groups))
        for i, na, nb, groups, links in cut
    ]


def some_rows(awkward):
    rng = random.Random(7)
    more = [
        "a  b   c\t d\n e ", " lead", "  two", "trail  ", "▁ piece", "x▁", "<|endoftext|> <s> </s> <unk> <0x41>", "don't I'll we've",
        "é ́ ﬁ x　y", "a\x00b", "� \U0001f600\U0001f600 日本", "\x1c x\x85 y", "1234567 89,0 3.14", "x" * 500, " ", "\n",
    ]
    letters = "ab éß \t\n12.,'日 ▁"
    more += ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(150)]
    return [*awkward, *((100 + i, t) for i, t in enumerate(more))]


def test_awkward_texts(documents, awkward):
    """Small blocks and a narrow tree, so that every step of the tree has work."""
    rows = some_rows(awkward)
    total, highest, expected = expected_rows(rows)
    assert sum(r[1] == 0 for r in expected) > 5 and sum(r[1] > r[3] > 0 for r in expected) > 50
    found = [tuple(r) for r in alignment.align(documents(rows), block=2000, fan=3).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    table = alignment.pair_table(alignment.counted(alignment.blocked(documents(rows), size=500)), fan=4)
    pairs = {(r["a"], r["b"]): (r["links"], r["best"]) for r in alignment.pair_counts(table).collect()}
    assert pairs == {x: (n, n == highest[x[1]]) for x, n in total.items()}


def test_nothing_to_align(documents):
    assert alignment.align(documents([])).count() == 0
    none = alignment.align(documents([(1, None), (2, ""), (3, "▁")])).collect()
    assert sorted(tuple(r) for r in none) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_units_are_forgotten(monkeypatch):
    """A worker's memory is bounded and changes no result."""
    monkeypatch.setattr(alignment, "KEPT", 3)
    monkeypatch.setattr(alignment, "TOGETHER", 2)
    own = alignment.Aligner(*alignment.vocabulary_paths())
    texts = ["one two three four", "two five six one seven", "one"]
    for _ in range(2):
        rows, units = own.block(texts)
        assert [";".join(units[i][2] for i in r) for r in rows] == [x[7] for x in expected_rows(list(enumerate(texts)))[2]]
        assert len(own.known) <= 3


def test_both_libraries_cut_units_of_simple_signs_alike():
    own = alignment.aligner(alignment.vocabulary_paths())
    rng = random.Random(1)
    signs = [chr(i) for i in range(1, 256) if not chr(i).isspace()]
    units = ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(4000)] + [f"{a}{b}" for a in signs for b in signs]
    text = " " + " ".join(units)
    assert own.brief.encode_ordinary(text) == own.a.encode(text, add_special_tokens=False).ids


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = driver.queries()["op11_alignment"](spark, SF_DIR)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in expected_rows(rows)[2]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
