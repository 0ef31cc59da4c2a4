"""Sparse incidence matrices in compressed rows, and their products row by row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from canvasser.llm.hashing import segments

STEP = 2_000_000  # products of entries held at once, about


@dataclass(frozen=True)
class Rows:
    """A matrix of ones and counts: row r holds ``values`` at the columns ``columns[starts[r]:starts[r + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Rows:
        """Columns become rows: a stable count sort of the entries."""
        owner = np.repeat(np.arange(self.height), np.diff(self.starts))
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        if _ascending(self.columns):  # as of ranges one behind the other
            return Rows(starts, owner, self.values, self.height)
        order = np.argsort(self.columns, kind="stable")
        return Rows(starts, owner[order], self.values[order], self.height)

    def times(self, vector: np.ndarray) -> np.ndarray:
        """Product with a vector."""
        sums = np.concatenate(([0], np.cumsum(self.values * vector[self.columns])))
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def __matmul__(self, other: Rows) -> Rows:
        """Gustavson's product: each row adds up the rows of ``other`` that its entries name."""
        fan = np.diff(other.starts)
        work = np.concatenate(([0], np.cumsum(fan[self.columns])))[self.starts]  # products before each row
        sizes, columns, values = [], [], []
        first = 0
        while first < self.height:
            last = max(first + 1, int(np.searchsorted(work, work[first] + STEP, "right")) - 1)
            a, b = self.starts[first], self.starts[last]
            inner = self.columns[a:b]
            entry, place = segments(fan[inner])
            row = np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1]))[entry]
            at = other.starts[inner][entry] + place
            key = row * other.width + other.columns[at]
            value = self.values[a:b][entry] * other.values[at]
            if not _ascending(key):
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            sizes.append(np.bincount(key[new] // other.width, minlength=last - first))
            columns.append(key[new] % other.width)
            values.append(np.add.reduceat(value, new) if len(new) else value)
            first = last
        none = np.zeros(0, np.int64)
        starts = np.concatenate(([0], np.cumsum(np.concatenate([none, *sizes]))))
        return Rows(starts, np.concatenate([none, *columns]), np.concatenate([none, *values]), other.width)


def _ascending(x: np.ndarray) -> bool:
    return bool((x[1:] >= x[:-1]).all())


def ranges(begins: np.ndarray, ends: np.ndarray, width: int) -> Rows:
    """One row per range, a one at each place from its begin up to its end."""
    _, place = segments(ends - begins)
    starts = np.concatenate(([0], np.cumsum(ends - begins)))
    columns = np.repeat(begins, ends - begins) + place
    return Rows(starts, columns, np.ones(len(columns), np.int64), width)


def members(groups: np.ndarray, width: int) -> Rows:
    """One row per member, a one at its group."""
    return Rows(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), width)
