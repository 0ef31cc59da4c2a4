"""Comparing the items of buckets, whatever the size of a bucket.

Memberships are rows (key, item). A bucket of more than ``block`` items is cut into chunks and
each pair of chunks becomes a cell of its own, so every pair of items of a bucket meets in exactly
one cell and no task gets more than two chunks of a bucket at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.llm.common import saved

CELL = ["key", "i", "j"]


def sized(members: DataFrame, least: int = 2) -> DataFrame:
    """Memberships of buckets with ``least`` items or more, with the size n of the bucket."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return members.join(sizes, "key")


def with_sizes(members: DataFrame, block: int, few: int = 10_000) -> DataFrame:
    """Memberships with n, the size of buckets above ``block``, and 1 for all others.

    Only the large buckets are joined back; while they are few, by broadcast.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    sizes = saved(sizes, "large-buckets")
    large = sizes.count()
    if not large:
        return members.withColumn("n", F.lit(1).cast("bigint"))
    joined = members.join(F.broadcast(sizes) if large <= few else sizes, "key", "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(1)))


def cells(members: DataFrame, block: int) -> DataFrame:
    """Memberships (with n) with cell (i, j) and the chunk of the item."""
    chunks = F.ceil(F.col("n") / block).cast("int")
    rows = members.withColumn("chunk", F.pmod(F.xxhash64("item", "key"), chunks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    return rows.drop("other")


def by_cell(rows: DataFrame, order: str = "item") -> DataFrame:
    """Rows dealt by cell and sorted, for ``whole_cells``."""
    return rows.repartition(*CELL).sortWithinPartitions(*CELL, order)


def _joined(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``least`` rows."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def whole_cells(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame], least: int = 1) -> Iterator[pd.DataFrame]:
    """Apply ``work`` to runs of rows that hold complete cells; the last cell waits for the next batch."""
    rest: list[pd.DataFrame] = []
    for batch in _joined(batches, least):
        last = (batch[CELL] == batch[CELL].iloc[-1]).all(axis=1).to_numpy()
        cut = len(batch) - int(np.argmin(last[::-1])) if not last.all() else 0
        if rest and not (rest[-1][CELL].iloc[-1] == batch[CELL].iloc[0]).all():
            yield work(pd.concat(rest, ignore_index=True))
            rest = []
        if cut:
            yield work(pd.concat([*rest, batch.iloc[:cut]], ignore_index=True))
            rest = []
        rest.append(batch.iloc[cut:])
    if rest:
        yield work(pd.concat(rest, ignore_index=True))


def cell_numbers(rows: pd.DataFrame) -> np.ndarray:
    """Number of the cell of each row, in order."""
    change = np.zeros(max(0, len(rows) - 1), bool)
    for c in CELL:
        column = rows[c].to_numpy()
        change |= column[1:] != column[:-1]
    return np.concatenate(([0], np.cumsum(change)))


def pairs(rows: pd.DataFrame, ratio: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (row numbers) that meet in the cells of ``rows``, in steps of one distance each.

    With ``ratio`` the rows of a cell come in order of their ``size``, and pairs whose smaller
    size is below that share of the larger one are left out.
    """
    cell = cell_numbers(rows)
    chunk = rows["chunk"].to_numpy()
    inner = (rows["i"] == rows["j"]).to_numpy()
    all_inner = bool(inner.all())
    size = rows["size"].to_numpy() if ratio else None
    left = np.arange(len(rows))
    step = 1
    while True:
        if len(left) and left[-1] + step >= len(rows):
            left = left[: np.searchsorted(left, len(rows) - step)]
        keep = cell[left] == cell[left + step]
        if ratio:
            keep &= size[left] >= ratio * size[left + step]
        left = left[keep]
        if not len(left):
            return
        use = left if all_inner else left[inner[left] | (chunk[left] != chunk[left + step])]
        if len(use):
            yield use, use + step
        step += 1


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def distinct_buckets(members: DataFrame) -> DataFrame:
    """Memberships without buckets that hold the same items as another one."""
    mark = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("item") % (2**40 - 87)).alias("s"), F.bit_xor(F.xxhash64("item", F.lit(1))).alias("x"))
    first = mark.filter("n > 1").groupBy("n", "s", "x").agg(F.min("key").alias("key"))
    return members.join(first.select("key", "n"), "key")
