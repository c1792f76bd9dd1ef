"""MinHash near-dedup by an LSH forest.

A text is the set of its distinct word shingles. Each set has a pool of minhash
values, and each tree of the forest orders the sets by the pool read from another
place on. Sets that stand together in some order with a long enough common prefix
are neighbours; the prefix asked for is as short as the threshold allows, so that a
pair at the threshold shares one in at least one order with a probability of all
but ``LOST``. Neighbours chain up to regions.

The depth adapts to the region. In one of up to ``BLOCK`` sets every two are held
against each other in full. In a larger one, such as that of pages with much text
in common, longer minhash prefixes would need ever more orders to lose nothing.
So its sets are ordered anew, each by its own shingles with those that are rare in
the region ahead: a pair at the threshold must share one of the first few, for
each set as many as it may lack, plus one. That is exact, whatever the order. Sets
that only share what the whole region does part company, what still hangs together
is a region of its own, and this goes on while regions fall apart.

Minhash and rare shingles only decide who meets: every link is confirmed on whole
sets, and neighbours met by chance do no harm. Large regions that remain are
families of near copies, which are compared in tiles.

Words are runs of anything but ASCII white space, A-Z in lower case. A text with
fewer words than a shingle has is one shingle; one without words, or null, has none
and links with nothing. Equal sets are one class throughout, so copies cost one
set. A null id has the component of its group, which is null if all ids of it
are; rows that repeat the least id are all kept. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import sliced, texts
from tallyhouse.llm.components import components
from tallyhouse.llm.union import join_groups
from tallyhouse.session import stored

TREES = 40
LOST = 1e-5  # of the pairs at the threshold, at most
BLOCK = 256  # sets that are compared in one task; a larger region is parted, or cut into tiles of half as many
SEEN = 64  # sets of a region, about, that tell which of its shingles are common; that only steers the order
PARTED = 0.9  # a larger share of its large regions' sets left in such ones ends the parting
LONG = 32  # bytes of a word beyond which it has a hash of another kind
CHUNK = 1 << 20  # bytes of text that are hashed at a time

_random = np.random.default_rng(11)
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def first_depth(threshold: float) -> int:
    """The longest prefix that still brings pairs at the threshold together."""
    depth = 1
    while (1 - threshold ** (depth + 1)) ** TREES <= LOST:
        depth += 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Shingle sets of many texts at once, as sorted 64-bit hashes."""

    def __init__(self, width: int):
        self.width = width
        self._powers(CHUNK)

    def _powers(self, n: int) -> None:
        back = pow(_BASE, -1, 1 << 64)
        self.ahead, self.back = (
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, back)
        )

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if len(data) > len(self.ahead):
            self._powers(len(data))
        gap = _SPACE[data]
        change = np.flatnonzero(np.diff(gap, prepend=True))  # word starts and ends in turn
        starts, ends = change[::2], change[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[np.where((data >= 65) & (data <= 90), data + 32, data)] * self.ahead[: len(data)], out=sums[1:])
        words = _mixed((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))
        raw = data.tobytes()
        for i in np.flatnonzero(ends - starts > LONG).tolist():  # long words can be made that sums of powers do not tell apart
            words[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].translate(_LOWER))
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.searchsorted(starts, bounds)
        rolled = np.zeros(len(words), np.uint64)
        for i in range(self.width):  # the shingle that begins at each word
            shifted = words[i:] if i else words
            rolled[: len(shifted)] = rolled[: len(shifted)] * np.uint64(0x100000001B3) + shifted
        rolled = _mixed(rolled)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= self.width:
                out.append(np.unique(rolled[a : b - self.width + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)  # the whole sequence; its length keeps it apart from longer shingles
                for i in range(a, b):
                    short = _mixed(short * np.uint64(0x100000001B3) + words[i : i + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _chunks(texts: list[bytes]):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def signatures(sets: list[np.ndarray], pool: int) -> np.ndarray:
    """``pool`` minhash values for each set that is not empty."""
    factors = (_VALUE[np.arange(pool) % 256] >> np.uint64(7) ^ np.arange(pool, dtype=np.uint64) * _MIX).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(sets), pool), np.uint32)
    for i, x in enumerate(sets):
        low = x.astype(np.uint32)
        least = None
        for at in range(0, len(low), 1024):
            own = (low[at : at + 1024, None] * factors).min(axis=0)
            least = own if least is None else np.minimum(least, own)
        out[i] = least
    return out


def prefixes(signature: np.ndarray, depth: int) -> np.ndarray:
    """For each tree, a key of the first ``depth`` values of its order."""
    pool = signature.shape[1]
    begin = np.arange(TREES) * (pool // TREES)
    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (len(signature), TREES)).copy()
    for i in range(depth):
        key = _mixed(key * np.uint64(0x100000001B3) + signature[:, (begin + i) % pool])
    return key.view(np.int64)


SCANNED = "id long, text_hash long, set_hash binary, n_shingles int, near array<long>"


def _scan(width: int, depth: int):
    def scan(batches):
        shingler = Shingler(width)
        for b in sliced(batches):
            sets: list[np.ndarray] = []
            near: list = []
            for chunk in _chunks(b.column("text").cast(pa.binary()).to_pylist()):
                own = shingler.sets(chunk)
                some = [i for i, x in enumerate(own) if len(x)]
                keys = prefixes(signatures([own[i] for i in some], TREES * depth), depth)
                rows: list = [None] * len(own)
                for i, row in zip(some, keys, strict=True):
                    rows[i] = row
                near.extend(rows)
                sets.extend(xxhash.xxh3_128_digest(x) + len(x).to_bytes(4, "little") if len(x) else b"" for x in own)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": b.column("id"),
                    "text_hash": b.column("text_hash"),
                    "set_hash": pa.array([x[:16] for x in sets], pa.binary()),
                    "n_shingles": pa.array([int.from_bytes(x[16:], "little") for x in sets], pa.int32()),
                    "near": pa.array(near, pa.list_(pa.int64())),
                }
            )

    return scan


def _sets(width: int):
    """Sets of representatives; a text that only shares its hash with one is left out."""

    def shingle(batches):
        shingler = Shingler(width)
        for b in sliced(batches):
            found = [x for chunk in _chunks(b.column("text").cast(pa.binary()).to_pylist()) for x in shingler.sets(chunk)]
            same = [xxhash.xxh3_128_digest(x) == h for x, h in zip(found, b.column("set_hash").to_pylist(), strict=True)]
            packed = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("class"), packed], names=["class", "set"]).filter(pa.array(same, pa.bool_()))

    return shingle


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets have in common."""
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    common = count[column] > 1
    _, column = np.unique(column[common], return_inverse=True)
    owners = owners[common]
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    out = np.zeros((len(sets), len(sets)))
    width = 8192  # members of sets looked at together
    n = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, n + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        has = np.zeros((len(sets), min(width, n - k * width)), np.float32)
        has[owners[a:b], column[a:b] - k * width] = 1
        out += has @ has.T
    return out


def _comparing(percent: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class")
        number, tile = rows["class"].to_numpy(), rows["tile"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        sizes = np.array([len(x) for x in sets])
        shared = shared_counts(sets)
        near = 100 * shared >= percent * (sizes[:, None] + sizes - shared)
        i, j = np.nonzero(np.triu(near, 1))
        root = join_groups(np.arange(len(rows)), i, j)
        linked = np.flatnonzero(root != np.arange(len(rows)))
        return pd.DataFrame({"a": number[linked], "b": number[root[linked]]})

    return compare


def _regions(classes: DataFrame) -> DataFrame:
    """``class`` and ``region`` of every class that has a neighbour by one of its keys."""
    forest = classes.select("class", F.explode("near").alias("key"))
    shared = forest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("first")).filter("n > 1")
    shared = stored(shared.select("key", "first"), "prefixes")  # a join on top of a sum cannot be split at a crowded prefix
    links = forest.join(shared, "key").select("class", "first")
    return components(links.toDF("a", "b")).toDF("class", "region")


def _sized(regions: DataFrame) -> DataFrame:
    sizes = stored(regions.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "regions")
    return stored(regions.join(sizes, "region").select("class", "region", "n"), "members")


def _common(rows: pd.DataFrame) -> pd.DataFrame:
    """The shingles that several of some sets of a region have, and how many do."""
    values, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["set"]]), return_counts=True)
    several = counts > 1
    packed = values[several].tobytes(), counts[several].astype("<u4").tobytes()
    return pd.DataFrame({"region": rows["region"].iloc[:1], "common": [packed[0]], "counts": [packed[1]]})


def rare_first(own: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set, rare ones ahead, as far as a set at the threshold must have one of them too."""
    weight = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, counts[at], 0)
    lacking = len(own) + (-percent * len(own)) // 100  # how many of them another one may lack
    return own[np.argsort(weight, kind="stable")[: lacking + 1]]


def _rare(percent: int):
    def keys(batches):
        for b in sliced(batches, "set"):
            near = []
            for region, own, common, counts in zip(*(b.column(c).to_pylist() for c in ("region", "set", "common", "counts")), strict=True):
                known = np.frombuffer(common or b"", np.uint64), np.frombuffer(counts or b"", "<u4")
                place = np.uint64(region * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)  # keys of one region are its own
                near.append(_mixed(rare_first(np.frombuffer(own, np.uint64), *known, percent) ^ place).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("class"), pa.array(near, pa.list_(pa.int64()))], names=["class", "near"])

    return keys


def _parted(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Large regions parted by rare shingles: ``class``, ``region`` and ``n`` anew."""
    one_in = F.ceil(F.col("n") / SEEN).cast("long")
    some = members.filter(F.pmod(F.xxhash64("class", "region"), one_in) == 0).join(sets, "class")
    common = stored(some.groupBy("region").applyInPandas(_common, "region long, common binary, counts binary"), "common")
    with_sets = members.select("class", "region").join(sets, "class").join(common, "region", "left")
    return _sized(_regions(stored(with_sets.mapInArrow(_rare(percent), "class long, near array<long>"), "rare")))


def neighbourhoods(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Regions (``class``, ``region`` and ``n``) as small as rare shingles make them."""
    large, left = members.filter(F.col("n") > BLOCK), None
    done = members.filter(F.col("n") <= BLOCK)
    while (before := large.count() if left is None else left) > 0:
        fresh = _parted(large, sets, percent)
        done = done.unionByName(fresh.filter(F.col("n") <= BLOCK))
        large = fresh.filter(F.col("n") > BLOCK)
        left = large.count()
        if left > PARTED * before:
            break
    return done.unionByName(large)


def minhash_dedup(
    df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, n_shingles, component_id and kept for every row of ``df``.

    Sets are linked if their intersection is at least ``percent`` hundredths of
    their union. Only keys and prefixes of all sets are shuffled, and whole texts
    once, to those classes that have neighbours; their sets are stored and go to the
    tiles of their region. A task returns one link per set that it joined to another.
    """
    depth = first_depth(percent / 100)
    docs = texts(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    scanned = stored(docs.mapInArrow(_scan(words, depth), SCANNED), "scanned")
    place = [F.first(c).alias(c) for c in ("text_hash", "near")]  # all of the same row
    classes = stored(
        scanned.filter("n_shingles > 0")
        .groupBy("set_hash")
        .agg(F.min("id").alias("least_id"), *place)
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    members = _sized(_regions(classes.select("class", "near")))
    wanted = members.select("class").join(classes.select("class", "set_hash", "text_hash"), "class")
    sets = stored(
        docs.select("text_hash", "text")
        .join(wanted, "text_hash")
        .select("class", "set_hash", "text")
        .mapInArrow(_sets(words), "class long, set binary")
        .groupBy("class")
        .agg(F.first("set").alias("set")),
        "sets",
    )
    tiles = F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(F.col("n") / (BLOCK // 2))).cast("long")
    members = neighbourhoods(members, sets, percent).select("class", "region", tiles.alias("tiles"))
    members = members.withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    placed = members.select("class", "region", "tile", partner.alias("partner")).join(sets, "class")
    blocks = placed.select(
        "class", "set", "region", "tile", F.least("tile", "partner").alias("one"), F.greatest("tile", "partner").alias("two")
    )
    links = blocks.groupBy("region", "one", "two").applyInPandas(_comparing(percent), "a long, b long")
    roots = components(links).withColumnRenamed("node", "class")
    grouped = classes.select("class", "set_hash", "least_id").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    grouped = grouped.join(least, "root").select("set_hash", "component_id", F.lit(True).alias("has"))
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("id"))
    rows = scanned.select("id", "set_hash", "n_shingles").join(grouped, "set_hash", "left")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n_shingles").cast("long").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
