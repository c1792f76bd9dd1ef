"""Quality by an n-gram model: interpolated modified Kneser-Ney over characters, one per language.

The model learns from trusted texts, those labelled good in three of five folds;
their n-grams are counted in full and its size follows theirs. Perplexities of
the trusted texts of a fourth fold, which the model has not seen, give each
language its limits, two outer quantiles; a text beyond them is not kept. The fifth
fold is left for measuring.

White space counts as one space, code points above 0xFFFF as one replacement, and
three marks stand before a text, so that an n-gram of four is a 64-bit number. A
null or empty text has no perplexity and is not kept. A null language is a
language of its own. Where a language has no trusted text to learn from or none to
set limits by, nothing is known against its texts and those with any are kept. A null
id is scored but never trusted. Repeated rows score alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import picked, sliced
from tallyhouse.session import stored

ORDER = 4  # characters of an n-gram; four of 16 bits fill a number
BLANK = re.compile(r"\s+")
LEARN, LIMIT = (2, 3, 4), 1  # folds of crc32(id) modulo 5


def codes(text: str) -> np.ndarray:
    """The n-grams of a text, one ending at each of its characters."""
    plain = BLANK.sub(" ", text).strip()
    points = np.frombuffer(plain.encode("utf-32-le"), "<u4")
    points = np.where(points > 0xFFFF, 0xFFFD, points).astype(np.uint64)
    padded = np.concatenate([np.zeros(ORDER - 1, np.uint64), points])
    n, out = len(points), np.zeros(len(points), np.uint64)
    for i in range(ORDER):
        out = out << np.uint64(16) | padded[i : i + n]
    return out.view(np.int64)


def _distinct(with_part: bool, counted: bool, packed: bool = False):
    """Distinct n-grams by language of all texts of a partition."""

    def distinct(batches):
        unpack = zstandard.ZstdDecompressor()
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang, found):
            if len(found):
                held[lang] = _merged([held[lang], *found]) if lang in held else _merged(found)

        column = "packed" if packed else "text"
        for b in sliced(batches, column, (1 << 20) if packed else (4 << 20)):
            new: dict[str | None, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column(column).to_pylist(), strict=True):
                new.setdefault(lang, []).append(codes(unpack.decompress(text).decode() if packed else text))
            for lang, arrays in new.items():
                add(lang, [np.unique(np.concatenate(arrays), return_counts=True)])
        part = TaskContext.get().partitionId()
        for lang, (grams, counts) in held.items():
            columns = {"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams)}
            if counted:
                columns["n"] = pa.array(counts)
            if with_part:
                columns = {"part": pa.array(np.full(len(grams), part))} | columns
            yield pa.RecordBatch.from_pydict(columns)

    return distinct


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)


def _context(gram: Column) -> Column:
    """All characters but the last."""
    return F.shiftrightunsigned(gram, 16)


def _shorter(gram: Column, order: int) -> Column:
    """All characters but the first, of an n-gram of ``order``."""
    return gram.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def _discounts(counts: DataFrame) -> DataFrame:
    """A language's three discounts from how many n-grams occur once to four times."""
    seen = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    found = counts.groupBy("lang").agg(*seen)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        exact = k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}")
        usable = (F.col("n1") > 0) & (F.col(f"n{k}") > 0) & (exact >= 0) & (exact <= k)
        return F.when(usable, exact).otherwise(0.5 * k).alias(f"d{k}")

    return found.select("lang", *[discount(k) for k in (1, 2, 3)])


def _left(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Left join on keys that may be null."""
    named = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(named, condition, "left").drop(*[f"_{k}" for k in keys])


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """lang, gram, p for the wanted n-grams (lang, gram, distinct) under the model of ``counts`` (lang, gram, n).

    From single characters up: a higher order takes from each count its discount
    and gives what it took to the order below. Lower orders count the different
    characters that an n-gram was seen after. Each step joins tables by n-gram
    and language and is spread over their keys.
    """
    tables, asked = {ORDER: counts}, {ORDER: wanted}
    for n in range(ORDER - 1, 0, -1):
        shorter = _shorter(F.col("gram"), n + 1).alias("gram")
        tables[n] = stored(tables[n + 1].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n")), "order")
        asked[n] = asked[n + 1].select("lang", shorter).distinct()
    letters = tables[1].groupBy("lang").agg(F.count(F.lit(1)).alias("letters"))
    below = _left(asked[1].select("lang", "gram"), letters, "lang").select(
        "lang", "gram", (1 / (F.col("letters") + 1)).alias("lower")
    )
    for n in range(1, ORDER + 1):
        own, context = tables[n], _context(F.col("gram")).alias("context")
        discounts = _discounts(own)
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        taken = _left(own, discounts, "lang").select("lang", context, "n", d.alias("d"))
        sums = taken.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        rows = _left(below, own, "lang", "gram").withColumn("context", _context(F.col("gram")))
        rows = _left(_left(rows, discounts, "lang"), sums, "lang", "context")
        kept = F.greatest(F.col("n") - d, F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(
            (F.coalesce(kept, F.lit(0.0)) + F.col("taken") * F.col("lower")) / F.col("total")
        )
        found = stored(rows.select("lang", "gram", p.alias("p")), "order")
        if n == ORDER:
            return found
        longer = asked[n + 1].withColumn("long", F.col("gram")).withColumn("gram", _shorter(F.col("gram"), n + 1))
        below = _left(longer, found, "lang", "gram").select("lang", F.col("long").alias("gram"), F.col("p").alias("lower"))


def _with_part(batches):
    part, pack = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
    for b in sliced(batches):
        packed = pa.array([pack.compress(x.encode()) for x in b.column("text").to_pylist()], pa.binary())
        where = pa.array(np.full(b.num_rows, part))
        yield pa.RecordBatch.from_arrays([where, b.column("id"), b.column("lang"), packed], names=["part", "id", "lang", "packed"])


def _score(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Perplexities of the texts of a partition, with the probabilities of all their n-grams."""
    unpack = zstandard.ZstdDecompressor()
    tables = {}
    for lang, own in known.groupby(known["lang"].fillna("\0"), sort=False):
        own = own.sort_values("gram")
        tables[lang] = own["gram"].to_numpy(), np.log(own["p"].to_numpy(np.float64))
    out, sizes = [], []
    for lang, packed in zip(rows["lang"].fillna("\0"), rows["packed"], strict=True):
        found = codes(unpack.decompress(packed).decode())
        sizes.append(len(found))
        if not len(found):
            out.append(None)
            continue
        grams, logs = tables[lang]
        at = np.searchsorted(grams, found)
        if at.max() >= len(grams) or (grams[at] != found).any():
            raise ValueError("a partition has changed since its n-grams were read; store the input first")
        out.append(float(np.exp(-logs[at].mean())) if not np.isnan(logs[at]).any() else None)
    scored = {"perplexity": pd.Series(out, dtype="float64"), "characters": sizes}
    return pd.DataFrame({"id": rows["id"].astype("Int64"), "lang": rows["lang"]} | scored)


def quality(
    df: DataFrame,
    labels: DataFrame,
    low: float = 0.01,
    high: float = 0.99,
    slack: float = 0.3,
    brief: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """``id_col``, lang, perplexity, lower, upper and kept for every row of ``df``.

    Limits are the quantiles ``low`` and ``high``, moved outwards by ``slack`` and,
    as the mean over n characters strays by about 1 / sqrt(n), by a factor of
    exp(``brief`` / sqrt(n)). The model never goes to all tasks: each input partition asks for the n-grams it
    has, once each, and gets back their probabilities.
    """
    docs = picked(df, id=id_col, lang=lang_col, text=text_col).select(
        F.col("id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    marks = picked(labels, id=id_col, good=label_col).select(F.col("id").cast("long").alias("id"), "good")
    trusted = marks.groupBy("id").agg(F.min("good").alias("good")).filter("id IS NOT NULL AND good > 0").select("id")
    fold = F.crc32(F.col("id").cast("string")) % 5
    rows = "part long, id long, lang string, packed binary"
    candidates = docs.filter(fold.isin(*LEARN)).mapInArrow(_with_part, rows)  # packed before the join may shuffle them
    learned = candidates.join(trusted, "id", "left_semi").select("lang", "packed")
    counted = learned.mapInArrow(_distinct(False, True, packed=True), "lang string, gram long, n long")
    counts = stored(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    # The same columns as below, so that both passes see the same partitions.
    asked = stored(docs.mapInArrow(_distinct(True, False), "part long, lang string, gram long"), "asked")
    known = probabilities(counts, asked.select("lang", "gram").distinct())
    answers = _left(asked, known, "lang", "gram")
    packed = docs.mapInArrow(_with_part, rows)
    scores = stored(
        packed.groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInPandas(_score, "id long, lang string, perplexity double, characters long"),
        "perplexities",
    )
    limit = scores.filter((fold == LIMIT) & F.col("perplexity").isNotNull()).join(trusted, "id", "left_semi")
    quantiles = limit.groupBy("lang").agg(F.percentile_approx("perplexity", [low, high], 10000).alias("q"))
    limits = quantiles.select(
        "lang", (F.col("q")[0] / (1 + slack)).alias("lower"), (F.col("q")[1] * (1 + slack)).alias("upper")
    )
    stray = F.exp(brief / F.sqrt(F.greatest("characters", F.lit(1))))
    judged = _left(scores, limits, "lang").withColumns({"lower": F.col("lower") / stray, "upper": F.col("upper") * stray})
    beyond = (F.col("perplexity") < F.col("lower")) | (F.col("perplexity") > F.col("upper"))
    kept = (F.col("characters") > 0) & ~F.coalesce(beyond, F.lit(False))
    return judged.select(F.col("id").alias(id_col), "lang", "perplexity", "lower", "upper", kept.alias("kept"))
