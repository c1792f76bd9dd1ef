"""Toxicity: a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, so that inflected forms meet.
A term's value is the square root of its share of the words. A score is the
logistic of a bias, a weighted sum of the values, and for every pair of terms the
inner product of their factors times both values: terms that are harmless alone
can count against a text together, and rare slips count less than a habit.

Labels come only from rows outside the held-out fold, from a bounded sample of
them (``sample_rows``, by a hash of the id). Everything else covers all rows and
whole texts. A null or empty text has no terms and gets the score of the bias.
A null id is scored, is not held out and is never learned from. Of several labels
of an id the highest counts; null labels do not. Without any label the score is
0, with one class only it is the smoothed share of label 1. An empty table gives an
empty result, repeated rows equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import picked, sliced, texts
from tallyhouse.session import stored

WORD = re.compile(r"[^\W\d_]+")
KNOWN_WORDS = 1 << 19  # entries a task keeps of word to terms; it starts afresh beyond that


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 16384  # labelled rows to learn from, at most
    terms: int = 8192  # terms of the model, at most: those that tell the labels apart best
    least_z: float = 3.0  # standard errors between a term's share of label 1 and the usual share
    least_docs: int = 3  # rows of the sample a term must be in
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7)
    hash_bits: int = 40
    factors: int = 8
    steps: int = 4000  # minibatches, whatever the size of the sample
    batch: int = 128
    rate: float = 0.2
    penalty: float = 1e-5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray  # a last entry of zeros stands for unknown terms
    factors: np.ndarray
    bias: float


def terms_of(word: str, settings: Settings) -> list[int]:
    mask = (1 << settings.hash_bits) - 1
    spelled = [f"{word[:n]}-" for n in settings.beginnings if len(word) >= n] + [word]
    return [(zlib.crc32(x.encode()) << 16 ^ zlib.adler32(x.encode())) & mask for x in spelled]


class Reader:
    """Values of the terms of a text; remembers words, up to a bound."""

    def __init__(self, settings: Settings, vocabulary: np.ndarray | None = None):
        self.settings, self.seen = settings, {}
        self.place = None if vocabulary is None else {t: i for i, t in enumerate(vocabulary.tolist())}

    def known(self, word: str) -> list[int]:
        if (own := self.seen.get(word)) is None:
            if len(self.seen) >= KNOWN_WORDS:
                self.seen.clear()
            own = terms_of(word, self.settings)
            if self.place is not None:
                own = [self.place[t] for t in own if t in self.place]
            self.seen[word] = own
        return own

    def values(self, text: str) -> tuple[list[int], list[float]]:
        words = Counter(WORD.findall(text.lower()))
        found: Counter[int] = Counter()
        for word, n in words.items():
            for term in self.known(word):
                found[term] += n
        total = max(1, sum(words.values()))
        terms = sorted(found)
        return terms, [(found[t] / total) ** 0.5 for t in terms]


def _raw(m: Model, rows: np.ndarray, values: np.ndarray, starts: np.ndarray):
    """Scores before the logistic, factor sums by row and factors by entry; no row is without an entry."""
    weighted = m.factors[rows] * values[:, None]
    summed = np.add.reduceat(weighted, starts)
    pairs = 0.5 * ((summed**2).sum(1) - np.add.reduceat((weighted**2).sum(1), starts))
    return m.bias + np.add.reduceat(m.weights[rows] * values, starts) + pairs, summed, weighted


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(terms: np.ndarray, documents: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, settings: Settings) -> Model:
    """Adagrad on the logistic loss over minibatches; ``documents`` are places in ``terms`` and values."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    n, random = len(terms), np.random.default_rng(settings.seed)
    w, v, bias = np.zeros(n + 1), random.normal(0, 0.05, (n + 1, settings.factors)), float(np.log(share / (1 - share)))
    v[n] = 0
    if len(np.unique(toxic)) < 2:
        return Model(terms, w, np.zeros_like(v), bias)
    gw, gv, gb = np.full(n + 1, 1e-4), np.full((n + 1, settings.factors), 1e-4), 1e-2
    padded = [(np.append(t, n), np.append(x, 0.0)) for t, x in documents]
    per_epoch = -(-len(padded) // settings.batch)
    for _ in range(-(-settings.steps // per_epoch)):
        order = random.permutation(len(padded))
        for at in range(0, len(order), settings.batch):
            own = order[at : at + settings.batch]
            rows, values = (np.concatenate([padded[i][k] for i in own]) for k in (0, 1))
            sizes = np.array([len(padded[i][0]) for i in own])
            raw, summed, weighted = _raw(Model(terms, w, v, bias), rows, values, np.cumsum(sizes) - sizes)
            error = _logistic(raw) - toxic[own]
            each = np.repeat(error, sizes) * values
            by_term = np.argsort(rows, kind="stable")
            used, cuts = np.unique(rows[by_term], return_index=True)
            dw = np.add.reduceat(each[by_term], cuts) / len(own) + settings.penalty * w[used]
            dv = each[:, None] * (np.repeat(summed, sizes, axis=0) - weighted)
            dv = np.add.reduceat(dv[by_term], cuts) / len(own) + settings.penalty * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += error.mean() ** 2
            w[used] -= settings.rate * dw / np.sqrt(gw[used])
            v[used] -= settings.rate * dv / np.sqrt(gv[used])
            bias -= settings.rate * float(error.mean()) / np.sqrt(gb)
            w[n], v[n] = 0, 0
    return Model(terms, w, v, float(bias))


def _counts(settings: Settings):
    def count(batches):
        reader, all_docs, marked = Reader(settings), Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = reader.values(text)[0]
                all_docs.update(own)
                if toxic:
                    marked.update(own)
        terms = list(all_docs)
        columns = {"term": terms, "docs": [all_docs[t] for t in terms], "marked": [marked[t] for t in terms]}
        yield pa.RecordBatch.from_pydict({k: pa.array(x, pa.int64()) for k, x in columns.items()})

    return count


def _features(settings: Settings, vocabulary: np.ndarray):
    def features(batches):
        reader = Reader(settings, vocabulary)
        for b in batches:
            found = [reader.values(x) for x in b.column("text").to_pylist()]
            terms = pa.array([t for t, _ in found], pa.list_(pa.int64()))
            values = pa.array([x for _, x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), terms, values, b.column("toxic")], names=["id", "terms", "values", "toxic"])

    return features


def _fitting(settings: Settings, vocabulary: np.ndarray):
    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "toxic"], kind="stable")  # whatever order they came in
        documents = [(np.asarray(t, np.int64), np.asarray(x)) for t, x in zip(rows["terms"], rows["values"], strict=True)]
        m = fit(vocabulary, documents, rows["toxic"].to_numpy(np.float64), settings)
        return pd.DataFrame([[m.weights.tobytes(), m.factors.tobytes(), m.bias]], columns=["weights", "factors", "bias"])

    return fitted


def held_out(id_col: str = "id"):
    """The fold that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, settings: Settings, id_col="doc_id", text_col="text", label_col="toxic") -> Model | None:
    """The model; None without labels. What comes to the driver is bounded by ``terms``."""
    marks = (
        picked(labels, id=id_col, toxic=label_col)
        .select(F.col("id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
        .filter("id IS NOT NULL AND toxic IS NOT NULL")
        .filter(~held_out())
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id", F.lit(settings.seed)), "id")
        .limit(settings.sample_rows)
    )
    # Two numbers for each of sample_rows rows at most are broadcast, and as many texts stored.
    sample = stored(texts(df, id_col, text_col).join(F.broadcast(marks), "id").select("id", "text", "toxic"), "labelled")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("marked")).first()
    if not size["n"]:
        return None
    share = size["marked"] / size["n"]
    expected = F.col("docs") * share
    spread = F.sqrt(F.col("docs") * max(share * (1 - share), 1e-12))
    chosen = (
        sample.mapInArrow(_counts(settings), "term long, docs long, marked long")
        .groupBy("term")
        .agg(F.sum("docs").alias("docs"), F.sum("marked").alias("marked"))
        .filter(F.col("docs") >= settings.least_docs)
        .select("term", (F.abs(F.col("marked") - expected) / spread).alias("z"))
        .filter(F.col("z") >= settings.least_z)
        .orderBy(F.desc("z"), "term")
        .limit(settings.terms)
        .collect()
    )
    vocabulary = np.sort(np.array([r["term"] for r in chosen], np.int64))
    rows = sample.mapInArrow(_features(settings, vocabulary), "id long, terms array<long>, values array<double>, toxic int")
    schema = "weights binary, factors binary, bias double"
    got = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fitting(settings, vocabulary), schema).first()
    weights, factors = (np.frombuffer(got[k], np.float64) for k in ("weights", "factors"))
    return Model(vocabulary, weights, factors.reshape(-1, settings.factors), got["bias"])


def _scoring(model: Model, settings: Settings):
    def score(batches):
        reader, unknown = Reader(settings, model.terms), len(model.terms)
        for b in sliced(batches):
            found = [reader.values(x) for x in b.column("text").to_pylist()]
            sizes = np.array([len(t) + 1 for t, _ in found], np.int64)
            rows = np.fromiter((x for t, _ in found for x in (*t, unknown)), np.int64, int(sizes.sum()))
            values = np.fromiter((x for _, v in found for x in (*v, 0.0)), np.float64, int(sizes.sum()))
            raw = _raw(model, rows, values, np.cumsum(sizes) - sizes)[0] if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_logistic(raw), pa.float64())], names=["id", "score"])

    return score


def toxicity(
    df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col="doc_id", text_col="text", label_col="toxic"
) -> DataFrame:
    """``id_col``, held_out, score and predicted for every row of ``df``."""
    model = train(df, labels, settings, id_col, text_col, label_col)
    docs = texts(df, id_col, text_col)
    if model is None:
        scored = docs.select("id", F.lit(0.0).alias("score"))
    else:
        scored = docs.mapInArrow(_scoring(model, settings), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col),
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
