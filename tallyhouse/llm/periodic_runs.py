"""Periodic runs of words, by maximal pairs of equal stretches.

A run is a stretch of words with period ``q`` (words ``q`` apart are equal), at
least ``2q`` and ``least`` words long, that neither neighbour prolongs. Its words
without the last ``q`` occur again ``q`` words on: a pair of equal stretches that
overlap or touch, with other words to their left and to their right. So maximal
pairs whose distance is no more than their length are the runs, whole as found,
and nothing is prolonged. A pair at a multiple of ``q`` is the same run again; of
pairs that cover the same words the least distance counts.

Pairs come from the suffix array of a text's words. Its LCP intervals are built
bottom up. An interval holds the places of its stretch in order, each in the class
of the word to its left, and takes over the places of its children, the fewer into
the more. Two places that thereby become neighbours differ in the word to the
right; if their classes differ too, the pair is maximal. Neighbours are enough: a
third equal stretch between the two of a run would give it a shorter period. So a
text of n words has O(n log n) candidates, however often a word or line repeats.

A pair of use is at least half of ``least`` long. Texts none of whose word grams
of that length occurs twice have no run and are not sorted at all, which is most
texts; places with shorter common stretches are in no interval.

Words are runs of anything but ASCII white space and are compared as they are. A
null text has none. Every row is worked on alone, so repeated rows, ids and null
ids are rows like any other; an empty table gives an empty result. A very long
text is one row's work: a suffix array of its words, about 150 bytes a word.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import picked, sliced

FEW = 16  # places that are put into a longer list one by one
_VALUE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
RESULT = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def numbered(words: list[bytes]) -> np.ndarray:
    """The number of each word among the distinct ones."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def repeats(ids: np.ndarray, width: int) -> bool:
    """Whether some gram of ``width`` words may occur twice; no repeated gram is missed."""
    n = len(ids) - width + 1
    if n < 2:
        return False
    values = (ids.astype(np.uint64) + np.uint64(1)) * _VALUE
    values ^= values >> np.uint64(29)
    grams = np.zeros(n, np.uint64)
    for i in range(width):
        grams = (grams + values[i : i + n]) * _MIX
        grams ^= grams >> np.uint64(32)
    grams.sort()
    return bool((grams[1:] == grams[:-1]).any())


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order, by doubling the sorted length."""
    n, width = len(ids), 1
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        steps = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = steps
        width *= 2
        if steps[-1] == n - 1 or width >= n:
            return order


def common_lengths(ids: list[int], order: list[int]) -> np.ndarray:
    """Words that each suffix has in common with the one before it in the order."""
    n = len(ids)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    before, place = before.tolist(), np.empty(n, np.int64)
    place[order] = np.arange(n)
    out, h = np.zeros(n, np.int64), 0
    lengths = []
    for i, j in enumerate(before):
        if j < 0:
            h = 0
        else:
            most = n - (i if i > j else j)
            while h < most and ids[i + h] == ids[j + h]:
                h += 1
        lengths.append(h)
        if h:
            h -= 1
    out[place] = lengths
    return out


def maximal_pairs(ids: list[int], order: list[int], common: list[int], shortest: int):
    """(start, distance, length) of maximal pairs between neighbouring places of an interval, no further apart than they are long."""
    found = []

    def tie(a: int, b: int, length: int) -> None:
        if b - a <= length and (a == 0 or ids[a - 1] != ids[b - 1]):  # the classes of the two
            found.append((a, b - a, length))

    def joined(more: list[int], fewer: list[int], length: int) -> list[int]:
        if len(more) < len(fewer):
            more, fewer = fewer, more
        n = len(more)
        for x in fewer:
            at = bisect_left(more, x)
            if at:
                tie(more[at - 1], x, length)
            if at < n:
                tie(x, more[at], length)
        if len(fewer) > FEW:
            return sorted(more + fewer)
        for x in fewer:
            insort(more, x)
        return more

    open_: list[tuple[int, list[int]]] = []  # intervals whose suffixes are not all seen, deeper ones later
    for leaf, length in zip(order, [*common[1:], 0], strict=True):  # with the next suffix
        if length < shortest:
            if not open_:
                continue
            length = 0
        places = [leaf]
        while open_ and open_[-1][0] > length:
            depth, own = open_.pop()
            places = joined(own, places, depth)
        if not length:
            continue
        if open_ and open_[-1][0] == length:
            places = joined(open_.pop()[1], places, length)
        open_.append((length, places))
    return found


def runs(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    shortest = -(-least // 2)
    if len(words) < least:
        return []
    ids = numbered(words)
    if not repeats(ids, shortest):
        return []
    order = suffix_array(ids).tolist()
    ids = ids.tolist()
    common = common_lengths(ids, order).tolist()
    periods: dict[tuple[int, int], int] = {}
    for start, distance, length in maximal_pairs(ids, order, common, shortest):
        if length + distance >= least:
            stretch = (start, length + distance)
            periods[stretch] = min(distance, periods.get(stretch, distance))
    return sorted(((start, length, q) for (start, length), q in periods.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that stay when only the first period of each run does, joined by one space."""
    if found:
        start, length, period = np.array(found).T
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return b" ".join(words)


def _finding(least: int, rewrite: Rewrite | None):
    run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def find(batches):
        for b in sliced(batches):
            counts, every, texts = [], [], []
            for own, text in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = text.split()
                if rewrite is not None:
                    words = rewrite(own, words)
                found = runs(words, least)
                counts.append(len(words))
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(collapsed(words, found))
            columns = [b.column("id"), pa.array(counts, pa.int64()), pa.array(every, run), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    return find


def periodic_runs(
    df: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None
) -> DataFrame:
    """``id_col``, n_words, runs (start, length and period of each, by start, then period) and collapsed for every row.

    ``collapsed`` is the text without the words that repeat: of each run the first
    period stays, unless another run covers it later than its own first one. It has
    one space between words. ``rewrite`` may put other words in the place of a
    row's, given its id and words. No row is moved.
    """
    docs = picked(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(_finding(least, rewrite), RESULT).withColumnRenamed("id", id_col)
