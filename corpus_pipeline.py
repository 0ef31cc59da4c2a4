"""From raw documents to token ids: toxic texts go, repeated lines go, near copies go, benchmark
texts go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; its result
is written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvasser.llm import bpe_tables, decontaminate, jaccard, lines, toxicity
from canvasser.llm.common import free_name, saved, table
from canvasser.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_toxic_score")
    return toxicity.score(docs, model, into=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal or nearly equal lines stays; ``n_chars`` follows the text that is left."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    removed = free_name(docs, "_removed_lines")
    rows = lines.dedup_lines(docs, mark=removed)
    return rows.withColumn("n_chars", F.when(F.size(removed) > 0, length).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.drop_near(docs)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): token ids, and whether they decode to the very text."""
    rows = bpe_tables.encode(docs.select("doc_id", "text"), vocabulary_path(), decoded="decoded")
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_texts),
    ("BPE encoding and decoding", encode_documents),
]

# Models, similarity joins and BPE are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return docs
