"""Document fingerprints by winnowing.

Every ``gram`` code points in a row have a rolling hash. Of every ``window``
neighbouring grams the one of least hash is marked, the rightmost of equal ones; a
fingerprint is the marks of a text, hash and place. So marks lie at most ``window``
grams apart, and a stretch of ``gram + window - 1`` code points that two texts share
leaves the same mark in both, at the same place of the stretch. The choice depends
on a window's own code points alone.

A text with fewer grams than a window has one window of all of them; one shorter
than a gram is a gram of its own; an empty or null text has no marks. Equal texts
have equal fingerprints. The likeness of two fingerprints is the share of hashes
that both have among those that either has, and 1 if neither has any.

Every row is worked on alone, very long texts in overlapping pieces, so repeated
rows, ids and null ids are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import partitions, sliced, texts

GRAM = 24  # code points
WINDOW = 40  # grams: stretches of 63 code points, some ten words, are found for sure
PIECE = 1 << 20  # grams of a text that are worked on at a time
BLOCKS = 3  # ranges of ids for each shuffle partition
_PLACE = 22  # bits of a sort key that hold the place; the others hold the hash
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
MARKS = "array<struct<hash:long,position:long>>"
COMPARED = f"id long, n_chars long, edited_sha256 string, marks {MARKS}, edited_marks {MARKS}, near_edited double, near_next double"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Winnower:
    """Marks of texts. A hash keeps as many of its upper bits as the choice of the least one looks at."""

    def __init__(self, gram: int = GRAM, window: int = WINDOW):
        self.gram, self.window = gram, window
        self.ahead = self.back = np.ones(1, np.uint64)

    def _hashes(self, points: np.ndarray, gram: int) -> np.ndarray:
        """The rolling hash of every gram: differences of running sums, taken back to the gram's own first power."""
        if len(points) > len(self.ahead):
            n, back = max(len(points), 1 << 16), pow(_BASE, -1, 1 << 64)
            self.ahead, self.back = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, back)
            )
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1)) * self.ahead[: len(points)], out=sums[1:])
        n = len(points) - gram + 1
        return _mixed((sums[gram:] - sums[:n]) * self.back[:n] + np.uint64(gram)) >> np.uint64(_PLACE)

    def _least(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the rightmost least hash of every window, each place once."""
        window, n = min(self.window, len(hashes)), len(hashes)
        last = np.uint64((1 << _PLACE) - 1)
        keys = (hashes << np.uint64(_PLACE)) | (last - np.arange(n, dtype=np.uint64))  # of equal hashes the later place is less
        span = 1
        while 2 * span <= window:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < window:
            keys = np.minimum(keys[: n - window + 1], keys[window - span :])
        places = last - (keys & last)
        return places[np.concatenate([[True], places[1:] != places[:-1]])].astype(np.int64)

    def marks(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places, by place."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram = min(self.gram, len(points))
        n = len(points) - gram + 1
        hashes, places = [], []
        for at in range(0, max(1, n - self.window + 1), PIECE):  # windows that begin here
            own = self._hashes(points[at : at + PIECE + self.window + gram - 2], gram)
            found = self._least(own)
            hashes.append(own[found].view(np.int64))
            places.append(found + at)
        place, first = np.unique(np.concatenate(places), return_index=True)
        return np.concatenate(hashes)[first], place


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Of the distinct hashes of either, the share that both have."""
    one, other = np.unique(one), np.unique(other)
    both = len(np.intersect1d(one, other, assume_unique=True))
    either = len(one) + len(other) - both
    return both / either if either else 1.0


def _listed(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0, *(len(h) for h, _ in found)]).astype(np.int32)
    columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 2
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=["hash", "position"]))


def fingerprints(
    df: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, n_chars and marks (hash and position of each, by position) for every row. No row is moved."""

    def mark(batches):
        winnower = Winnower(gram, window)
        for b in sliced(batches):
            own = b.column("text").to_pylist()
            columns = [b.column("id"), pa.array([len(t) for t in own], pa.int64()), _listed([winnower.marks(t) for t in own])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_chars", "marks"])

    return texts(df, id_col, text_col).mapInArrow(mark, f"id long, n_chars long, marks {MARKS}").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of another, or all of that."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


def _described(rows: list[tuple], winnower: Winnower) -> pa.RecordBatch:
    """Of (id, text, next text) in order; a text that is the next one of the row before is marked once."""
    out: dict[str, list] = {c.split()[0]: [] for c in COMPARED.split(", ")}
    last, marks_of_last = None, None
    for own, text, following in rows:
        marks = marks_of_last if text is last else winnower.marks(text)
        last, marks_of_last = following, winnower.marks(following)
        new = edited(text, following)
        new_marks = winnower.marks(new)
        near = likeness(marks[0], new_marks[0]), likeness(marks[0], marks_of_last[0])
        values = (own, len(text), hashlib.sha256(new.encode()).hexdigest(), marks, new_marks, *near)
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)
    kinds = {"edited_sha256": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return pa.RecordBatch.from_pydict(
        {c: _listed(v) if c.endswith("marks") else pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()}
    )


def _dealt(heads: list[tuple]):
    """Texts with the block of their key; the first key of a block goes also to the end of the block before, the first of all to the last."""

    def deal(batches):
        sent = set()  # one copy from each task, even of rows that repeat
        for b in sliced(batches):
            ids, hashes, own = (b.column(c).to_pylist() for c in ("id", "hash", "text"))
            keys = [_key(i, h) for i, h in zip(ids, hashes, strict=True)]
            blocks = [bisect_right(heads, k) - 1 for k in keys]
            rows = list(zip(blocks, [False] * len(ids), ids, hashes, own, strict=True))
            for k, row in zip(keys, list(rows), strict=True):
                if heads[row[0]] == k and k not in sent:
                    sent.add(k)
                    rows.append(((row[0] - 1) % len(heads), True, *row[2:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["block", "copy", "id", "hash", "text"],
            )

    return deal


def _neighbours(gram: int, window: int):
    """Each row with the one after it in its block."""

    def compare(batches):
        winnower = Winnower(gram, window)
        before = None
        for b in sliced(batches):
            own = list(zip(*(b.column(c).to_pylist() for c in ("block", "copy", "id", "text")), strict=True))
            chain = [before, *own] if before else own
            before = chain[-1]
            yield _described([(x[2], x[3], y[3]) for x, y in zip(chain[:-1], chain[1:], strict=True) if x[0] == y[0] and not x[1]], winnower)

    return compare


def _key(own: int | None, text_hash: int) -> tuple:
    """Rows are in the order of this: null ids first."""
    return (own is not None, own or 0, text_hash)


def compared_to_next(
    df: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, n_chars, marks, edited_sha256, edited_marks, near_edited and near_next for every row.

    The next row is the one of the next id, after the last the first; null ids come
    first, texts of one id follow by their hash, and a single row is its own next.
    The edited text is this row's with its last quarter replaced by the beginning of
    the next one.

    Ids are dealt into ranges first, without their texts; the driver gets the first
    id of each range. Texts then move once, to their range, and the first of a range
    also to the end of the one before, so every row meets its next one in one task.
    Rows alike in id and text stay in one range.
    """
    spark = df.sparkSession
    docs = texts(df, id_col, text_col).select("id", F.xxhash64("text").alias("hash"), "text")
    n = partitions(spark)
    ranges = docs.select("id", "hash").repartitionByRange(BLOCKS * n, "id", "hash")
    firsts = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id", "hash")).alias("head"))
    heads = sorted(_key(*r["head"]) for r in firsts.collect())  # a row for each range
    dealt = docs.mapInArrow(_dealt(heads), "block long, copy boolean, id long, hash long, text string")
    sorted_ = dealt.repartition(n, "block").sortWithinPartitions("block", "copy", "id", "hash")
    return sorted_.mapInArrow(_neighbours(gram, window), COMPARED).withColumnRenamed("id", id_col)
