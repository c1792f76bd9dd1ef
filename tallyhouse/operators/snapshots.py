"""Versioned vector tables: whole versions, and changes to them that a read puts together."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Moment, as_moment

# Sorts by time as text, unlike a day-first stamp.
VERSION_FORMAT = "%Y%m%d%H%M%S"
MANIFEST = "model_id string, version string, path string, saved_at timestamp, kind string"

# What a line of the manifest stands for; lines without a kind are whole versions.
WHOLE, CHANGES = "whole", "changes"


def _line(spark: SparkSession, root: str, *values: str | None) -> None:
    line = spark.createDataFrame([values], MANIFEST)
    line.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifest")


def _fresh(root: str, model_id: str, version: str) -> str:
    return f"{root}/vectors/model_id={quote(model_id, safe='')}/version={version}/save={uuid.uuid4().hex}"


def save_vectors(vectors: DataFrame, root: str, model_id: str, as_of: Moment) -> str:
    """Store a version of a model's vectors and list it once it is complete.

    Every save writes to a directory of its own and its manifest line after the
    data, so neither a job lost half way nor a save of the same version again
    touches anything that can be loaded. Of several saves of a version the latest
    is loaded.
    """
    version = as_moment(as_of).strftime(VERSION_FORMAT)
    path = _fresh(root, model_id, version)
    vectors.write.parquet(path)
    _line(vectors.sparkSession, root, model_id, version, path, None, WHOLE)
    return version


def save_changes(added: DataFrame, removed: DataFrame, root: str, model_id: str, as_of: Moment) -> str:
    """Store what a version changes in the one before it: rows that are new or replace those of their ``vec_id``, and ids that go.

    Only these are written. An id that is both is replaced. Rows of ``added`` have
    the columns of the vectors; they are listed once they are complete.
    """
    version = as_moment(as_of).strftime(VERSION_FORMAT)
    path = _fresh(root, model_id, version)
    added.write.parquet(f"{path}/added")
    removed.select("vec_id").write.parquet(f"{path}/removed")
    _line(added.sparkSession, root, model_id, version, path, None, CHANGES)
    return version


def load_vectors(spark: SparkSession, root: str, model_id: str, as_of: Moment | None = None) -> DataFrame:
    """The latest complete version of exactly this model, or the latest up to a moment.

    That is the last whole version and the changes listed after it. The whole version
    is only asked which of its rows have not changed; changes are put together among
    themselves, so what moves is in proportion to them.
    """
    saved = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where(F.col("model_id") == model_id)
    if as_of is not None:
        saved = saved.where(F.col("version") <= as_moment(as_of).strftime(VERSION_FORMAT))
    lines = saved.orderBy("version", "saved_at", "path").collect()  # a line for each save
    wholes = [i for i, r in enumerate(lines) if r["kind"] != CHANGES]
    if not wholes:
        raise LookupError(f"no saved vectors of model {model_id!r}")
    vectors = spark.read.parquet(lines[wholes[-1]]["path"])
    later = lines[wholes[-1] + 1 :]
    if later:
        vectors = _changed(spark, vectors, [r["path"] for r in later])
    return vectors.withColumns({"model_id": F.lit(model_id), "version": F.lit(lines[-1]["version"])})


def _changed(spark: SparkSession, vectors: DataFrame, paths: list[str]) -> DataFrame:
    """``vectors`` after some changes, in their order; of each id the last one counts."""
    columns = vectors.columns
    steps = None
    for i, path in enumerate(paths):
        row = F.struct(*[F.col(f"`{c}`") for c in columns])
        added = spark.read.schema(vectors.schema).parquet(f"{path}/added").select("vec_id", F.lit(2 * i + 1).alias("step"), row.alias("row"))
        gone = spark.read.schema("vec_id bigint").parquet(f"{path}/removed")
        gone = gone.select(F.col("vec_id").cast(vectors.schema["vec_id"].dataType), F.lit(2 * i).alias("step"), F.lit(None).alias("row"))
        own = added.unionByName(gone)
        steps = own if steps is None else steps.unionByName(own)
    last = steps.groupBy("vec_id").agg(F.max_by("row", "step").alias("row"))
    kept = vectors.join(last.select("vec_id"), "vec_id", "left_anti").select(columns)
    return kept.unionByName(last.where("row IS NOT NULL").select("row.*"))


def fold_vectors(spark: SparkSession, root: str, model_id: str) -> str:
    """Write the latest version as a whole one, so that a read has no changes to put together. Earlier versions stay as they are."""
    latest = load_vectors(spark, root, model_id)
    version = latest.select("version").first()
    if version is None:  # all rows are gone
        saved = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where(F.col("model_id") == model_id)
        version = saved.agg(F.max("version")).first()
    path = _fresh(root, model_id, version[0])
    latest.drop("model_id", "version").write.parquet(path)
    _line(spark, root, model_id, version[0], path, None, WHOLE)
    return version[0]
