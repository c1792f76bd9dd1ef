"""Cross-tokenizer alignment: which tokens of one vocabulary end where tokens of another do, and how often which do.

A text's bytes are cut by a byte-level vocabulary (A) and by a vocabulary of pieces
with byte fallback (B). Offsets where a token of both ends cut the text into groups;
the two tokens that end there are linked. How often an id pair is linked is counted
over the whole corpus, in two passes over the texts:

1. Texts are put into blocks and aligned; a block leaves the distinct pairs of its
   links with their counts. Distinct pairs are gathered in a tree, and those of each
   shard of B ids get a minimal perfect hash function. Every block's counts become
   dense vectors that the hash indexes, which are summed in a tree.
2. A block's pairs are looked up, each verified against the key kept under its
   number. The block's texts then are aligned again, and every link has its count.

A shard holds all pairs of its B ids, at most so many times the size of A, so a
shard is bounded by the vocabularies, whatever the corpus; a tree step reads a
bounded number of vectors. Neither pairs nor counts pass through the driver.

Texts are aligned in units that begin at a space after anything but white space:
neither vocabulary has a token across such a place, so units are cut alike wherever
they stand, and a worker keeps the alignment of those it has met, up to a bound.

The text of A is the text with a space ahead, which B adds by itself; special
spellings are plain text to both. A null or empty text, or one whose tokens do not
join to these bytes again, has no tokens. Repeated rows count each, null ids are
rows like any other, a long text is a block of its own and an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import texts
from tallyhouse.llm.perfect_hash import build, numbers, verified
from tallyhouse.session import stored

SHARDS = 128  # of B ids
BLOCK = 4 << 20  # bytes of text in a block
FAN = 512  # vectors that one step of a tree takes
KEPT = 3 << 17  # units whose alignment a worker remembers
LONGEST = 64  # characters of such a unit
TOGETHER = 4096  # units that are encoded in one call
_CUT = re.compile(r"(?<=\S)(?= )")
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "  # of the ASCII signs
_ODD = re.compile(r"(?:^|\s) ")  # spaces at which no unit begins
_PREFIX = "x"  # stands ahead of a unit, so that B adds its space there
_aligners: dict[tuple[str, str], Aligner] = {}

PARTS = "block long, shard int, keys binary, counts binary"
ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
TABLE = "shard int, function binary, keys binary, counts binary, best binary"


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligner(paths: tuple[str, str]) -> Aligner:
    """The aligner of this Python worker, kept between tasks and passes."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _byte_of_sign() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _of_piece(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def units_of(text: str) -> list[str]:
    """The units of a text that has a space ahead, each without the space it begins with."""
    if _ODD.search(text) is None:
        return text.split(" ")
    return [u[1:] for u in _CUT.split(" " + text)]


class Aligner:
    """Alignments of units: (A tokens, B tokens, groups as text, keys of the links), or None for one that does not join to its bytes.

    Units of code points below 256 are cut by a faster library with the same ids,
    whose order is that of A's merges; both agree on what these code points are.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs = _byte_of_sign()
        words = self.a.get_vocab()
        self.a_bytes = [b""] * (max(words.values()) + 1)
        ranks = {}
        for word, i in words.items():
            if all(c in signs for c in word):
                self.a_bytes[i] = bytes(signs[c] for c in word)
                ranks[self.a_bytes[i]] = i
            else:  # special spellings, which no text has
                self.a_bytes[i] = word.encode()
        ranks = {x: i for x, i in ranks.items() if i not in self.a.get_added_tokens_decoder()}
        self.brief = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b_bytes = [_of_piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if any(b" " in x.lstrip(b" ") for x in self.b_bytes) or max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("pieces reach across spaces, or ids across two bytes")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.ahead = len(self.b.encode(_PREFIX))
        self.known: dict[str, tuple | None] = {}

    def _align(self, units: list[str], simple: bool) -> list[tuple | None]:
        """The alignments of some units, encoded one behind the other; only the last one may end in white space."""
        text = " " + " ".join(units)
        data = text.encode()
        a = np.array(self.brief.encode_ordinary(text) if simple else self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(_PREFIX + text)[self.ahead :], np.int64)
        whole = all(b"".join([own[i] for i in ids.tolist()]) == data for own, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        if not whole:
            if len(units) == 1:
                return [None]
            half = len(units) // 2
            return self._align(units[:half], simple) + self._align(units[half:], simple)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        keys = (b[b_last] << 16 | a[a_last]).astype("<u8").tobytes()
        bounds = np.cumsum([1 + len(u) if u.isascii() else 1 + len(u.encode()) for u in units])
        edges = [np.concatenate([[0], np.searchsorted(x, bounds, side="right")]).tolist() for x in (a_ends, b_ends, ends)]
        a_words, b_words = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_cuts, b_cuts = [0, *(a_last + 1).tolist()], [0, *(b_last + 1).tolist()]
        groups = [
            f"{a_words[i] if j - i == 1 else ','.join(a_words[i:j])}|{b_words[k] if m - k == 1 else ','.join(b_words[k:m])}"
            for i, j, k, m in zip(a_cuts, a_cuts[1:], b_cuts, b_cuts[1:], strict=False)
        ]
        of_a, of_b, of_groups = edges
        return [
            (n, m, ";".join(groups[x:y]), keys[8 * x : 8 * y])
            for n, m, x, y in zip(np.diff(of_a).tolist(), np.diff(of_b).tolist(), of_groups, of_groups[1:], strict=False)
        ]

    def block(self, texts: list[str]) -> tuple[list[np.ndarray], list[tuple | None]]:
        """The units of each text, as places in a list of the distinct ones' alignments."""
        place: dict[str, int] = {}
        rows = [np.array([place.setdefault(u, len(place)) for u in units_of(t)] if t else [], np.int64) for t in texts]
        new = [u for u in place if u not in self.known]
        found: dict[str, tuple | None] = {}
        simple, other = [], []
        for u in new:
            if u.isascii() and u and u[-1] not in _WHITE:
                simple.append(u)
            elif not u or u[-1].isspace():
                found[u] = self._align([u], False)[0]
            else:
                (simple if max(u) < "\u0100" else other).append(u)
        for units, plain in ((simple, True), (other, False)):
            for at in range(0, len(units), TOGETHER):
                some = units[at : at + TOGETHER]
                found.update(zip(some, self._align(some, plain), strict=True))
        own = [found[u] if u in found else self.known[u] for u in place]
        if len(self.known) < KEPT:  # what comes first is kept, as frequent units do
            self.known.update(islice(((u, x) for u, x in found.items() if len(u) <= LONGEST), KEPT - len(self.known)))
        return rows, own


def _links(units: list[tuple | None]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all units' links and how many each has."""
    packed = [u[3] if u is not None else b"" for u in units]
    return np.frombuffer(b"".join(packed), "<u8"), np.array([len(x) // 8 for x in packed], np.int64)


def _whole(rows: list[np.ndarray], valid: np.ndarray) -> list[np.ndarray]:
    """Texts that hold a unit which does not join to its bytes have no units."""
    return rows if valid.all() else [r if valid[r].all() else r[:0] for r in rows]


def _blocked(size: int):
    """Texts with the block they are in: neighbours, about ``size`` bytes together."""

    def number(batches):
        block, held = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            blocks = []
            for n in pc.binary_length(b.column("text")).to_pylist():
                if held and held + n > size:
                    block, held = block + 1, 0
                held += n
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), b.column("id"), b.column("text")], names=["block", "id", "text"])

    return number


def _counted(paths: tuple[str, str]):
    """The distinct pairs of each block's links, by shard, with their counts. A block that is read in parts is counted in parts."""

    def rows_of(block: int, own: list[str]):
        rows, units = aligner(paths).block(own)
        valid = np.array([u is not None for u in units], bool)
        rows = _whole(rows, valid)
        used = np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=len(units))
        every, sizes = _links(units)
        times = np.repeat(used, sizes)
        keys, at = np.unique(every[times > 0], return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, times[times > 0])
        shard = ((keys >> np.uint64(16)) % np.uint64(SHARDS)).astype(np.int64)
        for s in np.unique(shard).tolist():
            mine = shard == s
            yield block, s, keys[mine].astype("<u4").tobytes(), counts[mine].tobytes()

    def count(batches):
        block, held, size = None, [], 0
        for b in batches:
            out = []
            for own, text in zip(b.column("block").to_pylist(), b.column("text").to_pylist(), strict=True):
                if held and (own != block or size > BLOCK):
                    out.extend(rows_of(block, held))
                    held, size = [], 0
                block = own
                held.append(text)
                size += len(text)
            yield _parts(out)
        if held:
            yield _parts(list(rows_of(block, held)))

    return count


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "shard": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())})


def _keys(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").astype(np.uint64)


def _one(columns: dict[str, tuple]) -> pa.Table:
    return pa.table({c: pa.array([v], k) for c, (v, k) in columns.items()})


def _distinct(last: bool):
    """The distinct keys of a group; at the top of the tree also their function, and keys in its order."""

    def union(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([_keys(x) for x in rows.column("keys").to_pylist()]))
        out = {"shard": (key[0].as_py(), pa.int32())}
        if not last:
            return _one(out | {"salt": (key[1].as_py(), pa.int64()), "keys": (keys.astype("<u4").tobytes(), pa.binary())})
        function = build(keys)
        ordered = np.empty(len(keys), "<u4")
        ordered[numbers(function, keys)] = keys
        return _one(out | {"function": (function, pa.binary()), "keys": (ordered.tobytes(), pa.binary())})

    return union


def _found(function: bytes, kept: bytes, keys: bytes) -> np.ndarray:
    at = verified(function, _keys(kept), _keys(keys))
    if (at < 0).any():
        raise ValueError("a pair was not there when the pairs were hashed: the blocks have changed")
    return at


def _dense(key: tuple[pa.Scalar, ...], parts: pa.Table, tables: pa.Table) -> pa.Table:
    """The counts of some blocks as one vector, indexed by the shard's function."""
    function, kept = tables.column("function")[0].as_py(), tables.column("keys")[0].as_py()
    total = np.zeros(len(kept) // 4, np.int64)
    for keys, counts in zip(parts.column("keys").to_pylist(), parts.column("counts").to_pylist(), strict=True):
        total[_found(function, kept, keys)] += np.frombuffer(counts, np.int64)
    return _one({"shard": (key[0].as_py(), pa.int32()), "salt": (key[1].as_py(), pa.int64()), "counts": (total.tobytes(), pa.binary())})


def _summed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = 0
    for counts in rows.column("counts").to_pylist():
        total = total + np.frombuffer(counts, np.int64)
    return _one({"shard": (key[0].as_py(), pa.int32()), "salt": (key[1].as_py(), pa.int64()), "counts": (total.tobytes(), pa.binary())})


def _ranked(batches):
    """Which pairs have the highest count of their B id."""
    for b in batches:
        best = []
        for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
            own, total = (_keys(keys) >> np.uint64(16)).astype(np.int64), np.frombuffer(counts, np.int64)
            highest = np.zeros(1 << 16, np.int64)
            np.maximum.at(highest, own, total)
            best.append((total == highest[own]).tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.binary())], names=[*b.schema.names, "best"])


def _looked_up(key: tuple[pa.Scalar, ...], parts: pa.Table, tables: pa.Table) -> pa.Table:
    """What the corpus knows of each block's pairs."""
    row = {c: tables.column(c)[0].as_py() for c in ("function", "keys", "counts", "best")}
    total, best = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["best"], bool)
    at = [_found(row["function"], row["keys"], keys) for keys in parts.column("keys").to_pylist()]
    return pa.table(
        {
            "block": parts.column("block"),
            "keys": parts.column("keys"),
            "counts": pa.array([total[i].tobytes() for i in at], pa.binary()),
            "best": pa.array([best[i].tobytes() for i in at], pa.binary()),
        }
    )


def _aligned(paths: tuple[str, str]):
    """The texts of a block, aligned again, with the counts of their links."""

    def align(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows, units = aligner(paths).block(docs.column("text").to_pylist())
        valid = np.array([u is not None for u in units], bool)
        rows = _whole(rows, valid)
        units = [u if u is not None else (0, 0, "", b"") for u in units]
        keys, counts, best = (
            np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in found.column(c).to_pylist())])
            for c, kind in (("keys", np.dtype("<u4")), ("counts", np.int64), ("best", bool))
        )
        order = np.argsort(keys, kind="stable")
        keys, counts, best = keys[order], counts[order], best[order]
        links, sizes = _links(units)
        at = np.minimum(np.searchsorted(keys, links), max(0, len(keys) - 1))  # links of texts without tokens may be unknown
        known = keys[at] == links if len(keys) else np.zeros(len(links), bool)
        bounds = np.concatenate([[0], np.cumsum(sizes)])

        def per_unit(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])

        n_best = per_unit((best[at] & known).astype(np.int64) if len(keys) else known.astype(np.int64))
        total = per_unit(np.where(known, counts[at], 0) if len(keys) else np.zeros(len(links), np.int64))
        n_a, n_b = (np.array([u[i] for u in units], np.int64) for i in (0, 1))
        written = [u[2] for u in units]

        def summed(values: np.ndarray) -> pa.Array:
            return pa.array([int(values[r].sum()) for r in rows], pa.int64())

        n_links = summed(sizes)  # a group ends with the one link it has
        groups = pa.array([";".join([written[i] for i in r.tolist()]) for r in rows], pa.string())
        columns = [docs.column("id"), summed(n_a), summed(n_b), n_links, n_links, summed(n_best), summed(total), groups]
        return pa.table(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])

    return align


def _salts(rows: DataFrame, fan: int) -> int:
    """How many groups of about ``fan`` blocks there are."""
    return max(1, -(-rows.agg(F.count_distinct("block")).first()[0] // fan))


def pair_table(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per shard: the hash function of its pairs, and by their numbers the keys, counts and whether a count is its B id's highest."""
    salts = _salts(parts, fan)

    def salted(df: DataFrame, column: str, n: int) -> DataFrame:
        return df.withColumn("salt", F.pmod(F.xxhash64(column), F.lit(n)))

    level, n = salted(parts.select("shard", "keys", "block"), "block", salts).drop("block"), salts
    while n > 1:
        level = stored(level.groupBy("shard", "salt").applyInArrow(_distinct(False), "shard int, salt long, keys binary"), "distinct")
        n = -(-n // fan)
        level = salted(level, "salt", n)
    functions = stored(level.groupBy("shard", "salt").applyInArrow(_distinct(True), "shard int, function binary, keys binary"), "functions")
    everywhere = functions.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salted_parts = salted(parts, "block", salts)
    vector = "shard int, salt long, counts binary"
    both = salted_parts.groupBy("shard", "salt").cogroup(everywhere.groupBy("shard", "salt"))
    sums, n = stored(both.applyInArrow(_dense, vector), "counts"), salts
    while n > 1:
        n = -(-n // fan)
        sums = stored(salted(sums, "salt", n).groupBy("shard", "salt").applyInArrow(_summed, vector), "counts")
    whole = functions.join(sums.select("shard", "counts"), "shard")
    return stored(whole.mapInArrow(_ranked, TABLE), "pairs")


def pair_counts(table: DataFrame) -> DataFrame:
    """``a``, ``b``, links and best of every id pair in a ``pair_table``."""

    def spell(batches):
        for b in batches:
            for keys, counts, best in zip(*(b.column(c).to_pylist() for c in ("keys", "counts", "best")), strict=True):
                own = _keys(keys).astype(np.int64)
                columns = [own & 0xFFFF, own >> 16, np.frombuffer(counts, np.int64), np.frombuffer(best, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "links", "best"])

    return table.mapInArrow(spell, "a long, b long, links long, best boolean")


def blocked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """Blocks of texts, stored, so that both passes see the same ones."""
    return stored(texts(df, id_col, text_col).mapInArrow(_blocked(size), "block long, id long, text string"), "blocks")


def counted(blocks: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The first pass: distinct pairs of the blocks' links, by shard, with their counts."""
    return stored(blocks.select("block", "text").mapInArrow(_counted(paths or vocabulary_paths()), PARTS), "parts")


def align(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    paths: tuple[str, str] | None = None,
    block: int = BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups for every row.

    ``groups`` has the ids of A and B of each group, ``a1,a2|b1;a3|b2,b3``. ``n_best``
    links have the highest count of their B id, ties included; ``count_sum`` adds up
    the counts of all links. Texts are written once and move once, in blocks.
    """
    paths = paths or vocabulary_paths()
    docs = blocked(df, id_col, text_col, block)
    parts = counted(docs, paths)
    table = pair_table(parts, fan)
    salts = _salts(parts, fan)
    everywhere = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    mine = parts.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    found = mine.groupBy("shard", "salt").cogroup(everywhere.groupBy("shard", "salt"))
    known = stored(found.applyInArrow(_looked_up, "block long, keys binary, counts binary, best binary"), "known")
    rows = docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_aligned(paths), ALIGNED)
    return rows.withColumnRenamed("id", id_col)
