"""Suffix-array dedup: repeated windows by a depth-limited radix sort, most significant digit first.

The suffixes of all texts are sorted only as deep as a window is long, and only
into groups of equal ones: a group of two or more at full depth is a repeated
window. Each pass sorts by a longer digit and drops groups of one:

1. Suffixes go in bundles. The bundle of an anchor is all windows in which the
   anchor's gram has the least hash, a choice that depends on nothing but the
   window's own bytes, so equal windows meet in bundles of equal grams, at equal
   offsets. The first digit is the gram.
2. Bundles are cut into cells of neighbouring offsets. The second digit is all
   bytes that the windows of a cell have in common.
3. Cells are cut into windows. The last digit is the whole window.

A bundle or cell that occurs elsewhere with all its bytes is settled at once: all
its windows are repeated, and one of each such class stands for it further on.
Digits are 128-bit fingerprints, so a pass is a count by digit that starts in the
tasks, and neither a crowded gram nor a group of copies is ever brought together.

A window is a number of bytes, or of words with what stands between them, from the
start of its first to the end of its last word. Words are runs of anything but
ASCII white space. Positions of bundles, cells and windows count in that unit.

Bytes are those of the UTF-8 text; a null text is empty. Windows never cross
texts, overlaps count, a text shorter than a window keeps all, and everything is
judged on the input. Repeated rows repeat each other's windows and a null id is a
row like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import partitions, sliced
from tallyhouse.session import discard, fresh_dir, stored

GRAM = 0.32  # of a window
CELLS = 8  # of a bundle at most
CHUNK = 1 << 20  # bytes whose grams are hashed at a time
_PLACE = 24  # bits of a sort key that hold the place, so that the first of equal grams is chosen
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
BUNDLE = "row long, low int, high int, anchor int, core binary, cover binary"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(_BASE, -1, 1 << 64)
    return tuple(
        np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, back)
    )


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring keys."""
    n = len(keys) - width + 1
    rows = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(keys)] = keys
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    change = np.flatnonzero(np.diff(_SPACE[np.frombuffer(data, np.uint8)], prepend=True, append=True))
    return change[::2], change[1::2]


def _word_values(data: bytes, starts: np.ndarray, ends: np.ndarray, powers) -> np.ndarray:
    ahead, back = powers
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[np.frombuffer(data, np.uint8)] * ahead[: len(data)], out=sums[1:])
    values = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    values ^= values >> np.uint64(32)
    return values * np.uint64(0xD6E8FEB86659FD93)


def bundles(data: bytes, begins: np.ndarray, window: int, powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, anchor) of the bundles in some texts one after another: windows low..high share the anchor."""
    return _bundles(_VALUE[np.frombuffer(data, np.uint8)], begins, window, powers)


def _bundles(values: np.ndarray, begins: np.ndarray, window: int, powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bundles of units, bytes or words, with these values."""
    gram = max(1, int(window * GRAM))
    if len(values) < window:
        return (np.zeros(0, np.int64),) * 3
    ahead, back = powers
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * ahead[: len(values)], out=sums[1:])
    n = len(values) - gram + 1
    hashed = (sums[gram:] - sums[:n]) * back[:n]
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(29)
    keys = (hashed >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(n, dtype=np.uint64)
    anchor = (_least(keys, window - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    inside = np.ones(len(anchor), bool)  # windows of one text
    for b in begins.tolist():
        inside[max(0, b - window + 1) : b] = False
    starts = np.flatnonzero(inside)
    own = anchor[starts]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(starts) != 1)])) if len(own) else np.zeros(0, int)
    last = np.append(first[1:], len(own)) - 1 if len(own) else first
    return starts[first], starts[last], own[first]


def _digest(*parts: bytes) -> bytes:
    return blake2b(b"".join(parts), digest_size=16).digest()


def _offsets(*numbers: int) -> bytes:
    return np.array(numbers, "<i4").tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    names = [x.split()[0] for x in BUNDLE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _reader(text: bytes, words: bool):
    """The bytes from one unit up to another."""
    if not words:
        return lambda a, z: text[a:z]
    starts, ends = (x.tolist() for x in word_places(text))
    return lambda a, z: text[starts[a] : ends[z - 1]]


def _pieces(text: bytes, window: int, words: bool, size: int):
    """A long text in overlapping pieces, with the unit at which each begins."""
    if not words:
        for base in range(0, len(text) - window + 1, size):
            yield base, text[base : base + size + window - 1]
        return
    starts, ends = word_places(text)
    step = size // 8
    for base in range(0, len(starts) - window + 1, step):
        yield base, text[starts[base] : ends[min(base + step + window - 1, len(ends)) - 1]]


def _first_digit(window: int, words: bool):
    def digits(batches):
        powers = _powers(CHUNK + 2 * window)
        gram = max(1, int(window * GRAM))

        def of(held):
            nonlocal powers
            data = (b" " if words else b"").join(x for _, _, x in held)
            ends = np.cumsum([len(x) + words for _, _, x in held])
            begins = ends - np.array([len(x) + words for _, _, x in held])
            if words:
                if len(data) > len(powers[0]):
                    powers = _powers(len(data))
                first, last = word_places(data)
                begins, ends = np.searchsorted(first, begins), np.searchsorted(first, ends)
                low, high, anchor = _bundles(_word_values(data, first, last, powers), begins[1:], window, powers)
                first, last = first.tolist(), last.tolist()

                def between(a, z):
                    return data[first[a] : last[z - 1]]
            else:
                low, high, anchor = bundles(data, begins[1:], window, powers)

                def between(a, z):
                    return data[a:z]

            out = []
            where = np.searchsorted(ends, anchor, side="right").tolist()
            for k, a, b, p in zip(where, low.tolist(), high.tolist(), anchor.tolist(), strict=True):
                row, base, _ = held[k]
                shift = base - int(begins[k])
                core, cover = _digest(between(p, p + gram)), _digest(_offsets(p - a, p - b), between(a, b + window))
                out.append((row, a + shift, b + shift, p + shift, core, cover))
            return _batch(out)

        held, size = [], 0
        for b in sliced(batches):
            for row, text in zip(b.column("row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for base, piece in _pieces(text, window, words, CHUNK):
                    if held and size + len(piece) > CHUNK + 2 * window:
                        yield of(held)
                        held, size = [], 0
                    held.append((row, base, piece))
                    size += len(piece)
        if held:
            yield of(held)

    return digits


def _cells(window: int, words: bool):
    """The cells of bundles, by the bytes common to a whole cell of offsets."""
    offsets = window - max(1, int(window * GRAM)) + 1
    width = -(-offsets // CELLS)

    def digits(batches):
        for b in sliced(batches, size=CHUNK):
            out = []
            for row, text, parts in zip(b.column("row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("parts").to_pylist(), strict=True):
                between = _reader(text, words)
                for part in parts:
                    low, high, p = part["low"], part["high"], part["anchor"]
                    for cell in range((p - high) // width, (p - low) // width + 1):
                        near, far = cell * width, cell * width + width - 1  # distances from window to anchor
                        a, z = max(low, p - far), min(high, p - near)
                        core = _digest(_offsets(cell), between(p - near, p - far + window))
                        out.append((row, a, z, p, core, _digest(_offsets(p - a, p - z), between(a, z + window))))
            yield _batch(out)

    return digits


def _windows(window: int, words: bool):
    def digits(batches):
        for b in sliced(batches, size=CHUNK):
            out = []
            for row, text, parts in zip(b.column("row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("parts").to_pylist(), strict=True):
                between = _reader(text, words)
                for part in parts:
                    for s in range(part["low"], part["high"] + 1):
                        whole = _digest(between(s, s + window))
                        out.append((row, s, s, part["anchor"], whole, whole))
            yield _batch(out)

    return digits


def _passed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of bundles with their digits: spans settled as repeated, and one of each class that needs a deeper digit."""
    # Stored before it is joined back: a join on top of a sum cannot be split at a crowded digit.
    alike = stored(found.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"), "alike")
    whole, found = found, stored(found.join(alike, "core", "left_semi"), "alike")
    discard(whole)  # most bundles occur once; what goes on is stored anew
    place = [F.first(c).alias(c) for c in ("row", "low", "high", "anchor")]  # all of the same bundle
    classes = stored(found.groupBy("core", "cover").agg(F.count(F.lit(1)).alias("n"), *place), "classes")
    settled = found.join(classes.filter("n > 1").select("cover"), "cover", "left_semi").select("row", "low", "high")
    split = stored(classes.groupBy("core").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("core"), "split")
    return settled, classes.join(split, "core", "left_semi").select("row", "low", "high", "anchor")


def _spans(kept: pa.DataType):
    def cut(batches):
        for b in sliced(batches):
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "spans": [], "kept": []}
            for text, parts in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("parts").to_pylist(), strict=True):
                spans: list[list[int]] = []
                places = [(p["low"], p["stop"]) for p in parts or () if not p["words"]]
                if len(places) < len(parts or ()):
                    starts, ends = word_places(text)
                    places += [(int(starts[p["low"]]), int(ends[p["stop"] - 1])) for p in parts if p["words"]]
                for low, stop in sorted(places):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([low, stop])
                edges = [0, *(e for s in spans for e in s), len(text)]
                out["n_bytes"].append(len(text))
                out["n_removed"].append(sum(e - s for s, e in spans))
                out["spans"].append([{"start": s, "stop": e} for s, e in spans])
                out["kept"].append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept": kept}
            if kept == pa.string():  # a character that a span cuts through goes with it
                out["kept"] = [x.decode(errors="ignore") for x in out["kept"]]
            columns = {"id": b.column("id"), "carried": b.column("carried")} | {c: pa.array(out[c], k) for c, k in kinds.items()}
            yield pa.RecordBatch.from_pydict(columns)

    return cut


def suffix_dedup(
    df: DataFrame,
    window: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
    as_text: bool = False,
    carry: tuple[str, ...] = (),
    words: int | None = None,
) -> DataFrame:
    """``id_col``, n_bytes, n_removed, spans (start and stop of the removed runs), kept (the other bytes) and ``carry`` for every row.

    Removed is every byte of a repeated run of ``window`` bytes and, if ``words`` is
    given, of a repeated run of so many words, however short these are.

    With ``as_text`` the kept bytes are a text again, without the characters that
    a span has cut through. Texts are shuffled once, into a table bucketed by row;
    what each pass finds goes to them by row, so texts do not move again. Passes
    are written to the shared folder.
    """
    spark = df.sparkSession
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(True)
    keyed = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(f"`{text_col}`", F.lit("")).alias("text"),
        carried.alias("carried"),
    )
    name, n = f"texts_{uuid.uuid4().hex}", partitions(spark)
    writer = keyed.repartition(n, "row").write.bucketBy(n, "row").sortBy("row")
    writer.option("path", fresh_dir(spark, "texts")).saveAsTable(name)
    docs = spark.table(name)

    def at(parts: DataFrame, how: str, *columns: str) -> DataFrame:
        """Texts with what was found in each, a list no longer than the text."""
        own = parts.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("parts"))
        return docs.join(own, "row", how)

    place = ("low", "high", "anchor")
    spans = None
    for size, in_words in ((window, False), (words, True)):
        if size is None:
            continue
        found = stored(docs.select("row", "text").mapInArrow(_first_digit(size, in_words), BUNDLE), "bundles")
        settled, open_ = _passed(found)
        own = settled
        for digit in (_cells(size, in_words), _windows(size, in_words)):
            found = stored(at(open_, "inner", *place).select("row", "text", "parts").mapInArrow(digit, BUNDLE), "digits")
            settled, open_ = _passed(found)
            own = own.union(settled)
        own = own.select("row", "low", (F.col("high") + size).alias("stop"), F.lit(in_words).alias("words"))
        spans = own if spans is None else spans.union(own)
    marked = at(spans, "left", "low", "stop", "words").select("id", "text", "parts", "carried")
    kind, arrow = ("string", pa.string()) if as_text else ("binary", pa.binary())
    schema = (
        f"id long, carried {marked.schema['carried'].dataType.simpleString()}, n_bytes long, n_removed long, "
        f"spans array<struct<start:long,stop:long>>, kept {kind}"
    )
    result = marked.mapInArrow(_spans(arrow), schema)
    columns = [F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", "kept"]
    return result.select(*columns, *[F.col("carried").getField(c).alias(c) for c in carry])
