"""Byte-level BPE by segment trees, and back.

Each match of the splitting pattern is a row of a batch of segment trees over its
byte positions. A leaf holds the rank of the pair that begins there, a node the
least rank below it with its leftmost position. A merge takes the root's pair and
updates three leaves, of the merged part, the part it swallowed and the live
neighbour before, each in logarithmic time. Matches of like length take their
merges side by side; distinct matches are merged once and remembered up to a bound.

A null or empty text has no ids. Repeated rows and null ids are rows like any
other, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import picked, sliced, texts
from tallyhouse.llm.units import Memory

# A task has a worker that encodes and one that decodes, and any worker may be given either part: what one holds counts
# four times in an executor of two cores.
CHUNK = 1 << 18  # characters that are cut at a time
CELLS = 1 << 17  # leaves of the trees worked on at a time
SLICE = 1 << 20  # bytes of text or ids taken from a batch at a time
DECODED = 1 << 16  # ids of a text that are decoded at a time
MATCHES = 1 << 19  # remembered matches
OTHER_MATCHES = 1 << 17  # remembered matches of texts with code points over 255
NONE = np.int64(1) << 62
# Fixed: what the pattern calls \s.
WHITE_SPACE = r"\t-\r \x85\xa0" + "".join(
    f"\\u{c:04x}" for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_encoders: dict[str, ByteEncoder] = {}
_decoders: dict[str, ByteDecoder] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(path: str) -> ByteEncoder:
    """The encoder of this Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def decoder(path: str) -> ByteDecoder:
    """The decoder of this Python worker, its encoder if it has one."""
    if path in _encoders:
        return _encoders[path]
    if path not in _decoders:
        _decoders[path] = ByteDecoder(read_ranks(path))
    return _decoders[path]


class Merges:
    """Ranks of adjacent parts, and the merging of whole batches of matches."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.rank_of = np.array([pairs[k] for k in self.keys.tolist()] + [0], np.int64)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(found, self.rank_of[at], -1)

    def encode(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches, flat, and how many each has. A match that is a token as a whole is that token."""
        whole = np.array([self.ranks.get(m, -1) for m in matches], np.int64)
        sizes = np.array([len(m) for m in matches], np.int64)
        ids: list[np.ndarray] = [whole[i : i + 1] for i in range(len(matches))]
        rest = np.flatnonzero(whole < 0)
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes[rest], 2))).astype(np.int64))
        for w in np.unique(width):
            own = rest[width == w]
            rows = max(1, CELLS // int(w))
            for at in range(0, len(own), rows):
                some = own[at : at + rows]
                parts, live = self._merged([matches[i] for i in some], int(w))
                flat, cuts = parts[live], np.cumsum(live.sum(1))[:-1]
                for i, x in zip(some.tolist(), np.split(flat, cuts), strict=True):
                    ids[i] = x
        counts = np.array([len(x) for x in ids], np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), counts

    def _merged(self, matches: list[bytes], w: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts by byte position (rows of ``w``) after all merges, and which positions still begin one."""
        k = len(matches)
        sizes = np.array([len(m) for m in matches], np.int64)
        raw = np.frombuffer(b"".join(m.ljust(w, b"\0") for m in matches), np.uint8).reshape(k, w)
        position = np.arange(w)
        live = position < sizes[:, None]
        parts = np.where(live, self.byte_ids[raw], 0)
        after = np.broadcast_to(position + 1, (k, w)).copy()  # the size of a match or more: no part follows
        before = np.broadcast_to(position - 1, (k, w)).copy()
        tree = np.full((k, 2 * w), NONE)
        pair = live[:, :-1] & live[:, 1:]
        rank = self.pair_ranks(parts[:, :-1][pair], parts[:, 1:][pair])
        leaf = np.full((k, w - 1), NONE)
        leaf[pair] = np.where(rank < 0, NONE, rank * w + np.broadcast_to(position[:-1], pair.shape)[pair])
        tree[:, w : 2 * w - 1] = leaf
        level = w
        while level > 1:
            half = level // 2
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
            level = half
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best = tree[row, 1]
            i = best % w
            swallowed = after[row, i]
            parts[row, i] = best // w
            live[row, swallowed] = False
            next_ = after[row, swallowed]
            after[row, i] = next_
            follows = next_ < sizes[row]
            before[row[follows], next_[follows]] = i[follows]
            self._set(tree, row, swallowed, np.full(len(row), NONE), w)
            self._set(tree, row, i, self._leaf(parts, row, i, next_, follows, w), w)
            previous = before[row, i]
            has = previous >= 0
            some, p = row[has], previous[has]
            self._set(tree, some, p, self._leaf(parts, some, p, i[has], np.ones(len(some), bool), w), w)
            row = row[tree[row, 1] < NONE]
        return parts, live

    def _leaf(self, parts, row, i, j, there, w) -> np.ndarray:
        out = np.full(len(row), NONE)
        rank = self.pair_ranks(parts[row[there], i[there]], parts[row[there], j[there]])
        out[there] = np.where(rank < 0, NONE, rank * w + i[there])
        return out

    @staticmethod
    def _set(tree, row, i, value, w) -> None:
        at = i + w
        tree[row, at] = value
        while w > 1:
            at = at >> 1
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
            w //= 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteDecoder:
    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, packed: list[bytes]) -> list[bytes]:
        return [b"".join(self._decoded(np.frombuffer(x, "<u4"))) for x in packed]

    def _decoded(self, all_ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(all_ids), DECODED):
            ids = all_ids[at : at + DECODED]
            sizes = self.sizes[ids]
            ends = np.cumsum(sizes)
            place = np.repeat(self.offsets[ids] - (ends - sizes), sizes)
            yield self.bytes[place + np.arange(len(place))].tobytes()


class ByteEncoder(ByteDecoder):
    def __init__(self, path: str):
        import regex

        ranks = read_ranks(path)
        super().__init__(ranks)
        self.merges = Merges(ranks)
        self.memory = Memory(self._learn, join_space=True, dtype=np.int32, most=MATCHES)
        self.pattern = regex.compile(pattern().replace(r"[^\s\p", rf"[^{WHITE_SPACE}\p").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]"))
        self.other: dict[str, np.ndarray] = {}

    def _learn(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.encode([m if m.isascii() else m.decode("latin-1").encode() for m in matches])

    def _others(self, text: str) -> np.ndarray:
        found = self.pattern.findall(text)
        new = list(set(found) - self.other.keys())
        if len(self.other) + len(new) > OTHER_MATCHES:
            self.other, new = {}, list(set(found))
        ids, counts = self.merges.encode([m.encode() for m in new])
        self.other.update(zip(new, np.split(ids, np.cumsum(counts)[:-1]), strict=False))
        return np.concatenate([self.other[m] for m in found]) if found else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        packed: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            if held:
                flat, counts = self.memory.encode([x for _, x in held])
                raw, at = flat.astype("<u4").tobytes(), 0
                for (i, _), n in zip(held, counts.tolist(), strict=True):
                    packed[i].append(raw[4 * at : 4 * (at + n)])
                    at += n
                held.clear()

        for i, text in enumerate(texts):
            for part in _parts(text):
                try:
                    held.append((i, part.encode("latin-1")))
                except UnicodeEncodeError:
                    flush()
                    packed[i].append(self._others(part).astype("<u4").tobytes())
                size += len(part)
                if size > CHUNK:
                    flush()
                    size = 0
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in packed]


def _parts(text: str) -> Iterator[str]:
    """The text, cut before some of the spaces that follow a sign, where no match reaches across."""
    at = 0
    while len(text) - at > CHUNK:
        end = text.find(" ", at + CHUNK)
        while end >= 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ids (binary, little-endian unsigned 32-bit) of every whole text."""
    where = path or vocabulary_path()

    def encoded(batches):
        for b in sliced(batches, size=SLICE):
            ids = encoder(where).encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary())], names=["id", "ids"])

    return texts(df, id_col, text_col).mapInArrow(encoded, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id_col``, ids and the decoded bytes; null ids decode to nothing, an id outside the vocabulary is an error."""
    where = path or vocabulary_path()

    def decoded(batches):
        for b in sliced(batches, "ids", SLICE):
            data = decoder(where).decode(b.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), pa.array(data, pa.binary())], names=["id", "ids", "bytes"])

    rows = picked(df, id=id_col, ids=ids_col).select("id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(decoded, f"id {kind}, ids binary, bytes binary").withColumnRenamed("id", id_col)
