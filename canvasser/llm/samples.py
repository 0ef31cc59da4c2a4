"""Labelled rows for fitting, chosen without looking at anything but the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
TUNING = 4  # fold that sets the calibration; folds between 0 and this one fit the model


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id is in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents of folds 1 to 4 as (doc_id, text, label, fold).

    The ids come first in the order of a hash of the id, so any corpus gives an even sample. Ids
    that are null, or labelled both ways, are left out; a repeated document counts once.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.filter(fold() != 0).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    chosen = known.filter("label = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "label")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows of two numbers
    return rows.dropDuplicates(["doc_id"]).withColumn("fold", fold())
