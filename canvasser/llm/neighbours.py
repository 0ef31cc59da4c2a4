"""Approximate nearest neighbours by cross-polytope hashing, several tables and several probes.

A table turns every vector by three rounds of random signs and a fast Hadamard transform and
takes the nearest signed axis as its bucket. A query looks into the buckets of its ``probes``
nearest signed axes in each table; what it finds there is ranked by exact inner products.

Equal vectors are one class: they share buckets and scores, so a vector that fills a third of the
table costs one row per table, and a class keeps the few smallest ids that any result can need.
Buckets are cut into cells of at most ``CELL`` vectors and ``CELL`` queries; every query of a
bucket meets every vector of it in exactly one cell, so no bucket is capped and none lands in one
task whole. A cell hands on the best of each query only.

Where a query has found fewer than it should, it looks again into all buckets (an exact search).

Nearest means largest inner product. If norms differ, vectors get one more coordinate that makes
them equally long and queries get 0 there, which keeps the order of the inner products.

With the default 16 tables and 8 probes the recall of the 20 nearest is above 0.97 on 64
dimensions with neighbours at cosines of 0.35 (see the README).

Defined results: vectors that are null, zero or hold null, NaN or infinite components, or whose
id is null, take no part, nor do those whose length is not the most frequent one. Of rows that
repeat an id the one with the smallest components counts. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvasser.llm.common import saved

TABLES = 16
PROBES = 8
CELL = 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), scaled to keep lengths."""
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, size // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def signs(tables: int, size: int) -> np.ndarray:
    """The random signs of every table: (tables, 3 rounds, size)."""
    return np.random.default_rng(20).choice([-1.0, 1.0], (tables, 3, size))


def signed_axes(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Projections on the signed axes of one table: columns 2i and 2i + 1 are axis i and its negative."""
    size = flips.shape[1]
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for round_ in flips:
        y = hadamard(y * round_)
    out = np.empty((len(x), 2 * size))
    out[:, 0::2], out[:, 1::2] = y, -y
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) with v the doubles as bytes; one row per id."""
    v = F.col("v")
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.aggregate(v, F.lit(True), lambda ok, x: ok & F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    own = own.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    own = own.groupBy("vec_id").agg(F.min("v").alias("v"))
    usual = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    own = own.join(F.broadcast(usual), F.size("v") == F.col("n")).drop("n")  # one row

    @F.pandas_udf("binary")
    def pack(lists: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(x, np.float64) + 0.0).tobytes() for x in lists], dtype=object)

    return own.select("vec_id", pack("v").alias("v"))


def _norms(vectors: DataFrame) -> tuple[float, float, int]:
    @F.pandas_udf("double")
    def norm(column: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(_matrix(column), axis=1))

    low, high, size = vectors.agg(F.min(norm("v")), F.max(norm("v")), F.max(F.length("v"))).first()
    return low or 0.0, high or 0.0, (size or 8) // 8


def _buckets(rows: DataFrame, flips: np.ndarray, probes: int, longest: float | None) -> DataFrame:
    """(t, axis, cls, v) of every probe; ``longest`` levels the norms of indexed vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(flips)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["v"])
            if longest is not None:
                rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]
                x = np.concatenate([x, rest], axis=1)
            for t, flip in enumerate(shared.value):
                near = signed_axes(x, flip)
                best = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(x), 1))
                at = np.repeat(np.arange(len(x)), best.shape[1])
                yield pd.DataFrame({"t": t, "axis": best.ravel(), "cls": batch["cls"].to_numpy()[at], "v": batch["v"].to_numpy()[at]})

    return rows.select("cls", "v").mapInPandas(run, "t int, axis int, cls long, v binary")


def _cells(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (i, j) in which a vector of chunk i meets a query of chunk j."""
    sizes = [side.groupBy("t", "axis").agg(F.ceil(F.count("*") / CELL).cast("int").alias(n)) for side, n in ((index, "ni"), (queries, "nj"))]
    sizes = F.broadcast(sizes[0].join(sizes[1], ["t", "axis"]))  # one row per table and signed axis at most
    chunk = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, ["t", "axis"]).select("t", "axis", chunk("ni").alias("i"), every("nj").alias("j"), "cls", "v")
    right = queries.join(sizes, ["t", "axis"]).select("t", "axis", every("ni").alias("i"), chunk("nj").alias("j"), "cls", "v")
    return left, right


def _best(index: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best classes of each query class in each cell: (q, c, score)."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "c": [], "score": []})
        left = left.sort_values("cls")
        x, ids = _matrix(left["v"]), left["cls"].to_numpy()
        out = []
        for a in range(0, len(right), 512):
            part = right.iloc[a : a + 512]
            y = _matrix(part["v"])
            near = y @ x.T
            n = min(keep, len(x))
            if n < len(x):
                least = -np.partition(-near, n - 1, axis=1)[:, n - 1 : n]
                which = near >= least - 1e-12 * np.abs(least)
            else:
                which = np.ones(near.shape, bool)
            r, k = np.nonzero(which)
            score = np.einsum("ij,ij->i", y[r], x[k])
            order = np.lexsort((ids[k], -score, r))
            r, k, score = r[order], k[order], score[order]
            first = np.searchsorted(r, np.arange(len(part)))
            top = np.arange(len(r)) - first[r] < n
            out.append(pd.DataFrame({"q": part["cls"].to_numpy()[r[top]], "c": ids[k[top]], "score": score[top]}))
        return pd.concat(out)

    left, right = _cells(index, queries)
    key = ["t", "axis", "i", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "q long, c long, score double")
    rank = F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= keep).drop("rank").distinct()


def search(rows: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    vectors = saved(valid_vectors(rows, vec_id, vector), "vectors")
    low, high, size = _norms(vectors)
    longest = None if low >= high * 0.999 else high
    width = 1 << max(1, (size + (longest is not None) - 1).bit_length())
    flips = signs(tables, width)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = vectors.withColumn("place", place).filter(F.col("place") <= k + 1)  # a result needs no more of a class
    classes = saved(first.groupBy("v").agg(F.min("vec_id").alias("cls"), F.sort_array(F.collect_list("vec_id")).alias("members")), "classes")
    queries = saved(vectors.filter(F.col("vec_id") % every == 0).join(classes.select("v", "cls"), "v").select("vec_id", "cls"), "queries")
    asked = classes.join(queries.select("cls").distinct(), "cls", "left_semi").select("cls", "v")
    index = _buckets(classes, flips, 1, longest)
    found = saved(_best(index, _buckets(asked, flips, min(probes, 2 * width), None), k + 1), "found")

    here = classes.select(F.col("cls").alias("c"), F.size("members").alias("n"))
    have = found.join(here, "c").groupBy("q").agg(F.sum("n").alias("n"))
    total = vectors.count()
    short = asked.join(have.filter(F.col("n") >= min(k + 1, total)), asked["cls"] == F.col("q"), "left_anti")
    short = saved(short, "short")
    if not short.isEmpty():
        again = _best(index.filter("t = 0"), _buckets(short, flips[:1], 2 * width, None), k + 1)
        found = found.join(short, found["q"] == short["cls"], "left_anti").unionByName(again)

    members = classes.select(F.col("cls").alias("c"), F.explode("members").alias("vec_id"))
    near = found.join(members, "c")
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("place", order).filter(F.col("place") <= k + 1)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    own = queries.withColumnRenamed("vec_id", "query_id").join(lists, F.col("cls") == F.col("q"))
    kept = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(kept).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
