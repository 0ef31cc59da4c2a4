"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvasser.session import fresh_path

LAST = 2**63 - 1  # a missing doc_id ranks behind all others


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, start: str) -> str:
    """A name that no column of ``df`` begins with."""
    while any(c.lower().startswith(start.lower()) for c in df.columns):
        start += "_"
    return start


def rank_id(column: str | Column) -> Column:
    """The id as a long that orders documents; a null id ranks last."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(LAST)).cast("long")


def spans(sizes: list, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` in all (one row at least); a null size counts as 0."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + (n or 0) > limit:
            yield begin, i
            begin, total = i, 0
        total += n or 0
    if begin < len(sizes):
        yield begin, len(sizes)


def pieces(texts: pd.Series, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters (one row at least)."""
    return spans([len(t) if t else 0 for t in texts], limit)
