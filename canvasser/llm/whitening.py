"""Whitening of embeddings by an incremental eigendecomposition.

1. Every entry c becomes the integer floor(64 * c) + 1,000,000; each distinct integer vector counts
   once (the fit list, saved). A vector of a third of all rows is one row per task before the
   shuffle.
2. Each partition keeps the spectrum of its scatter matrix (values, vectors, mean, count) and applies
   one centred rank-one update for each vector: the secular equation is solved for all roots at once,
   after deflation of zero weights and of equal poles (``rank_one``).
3. Spectra are combined in groups of ``FAN_IN`` until one is left: the eigenpairs of one, and the
   difference of the means, are rank-one updates of the other.
4. Rayleigh-Ritz: one more pass adds up the covariance in the basis found, centred by the exact
   mean; its eigenvectors turn the basis into that of the covariance to double precision.
5. Rows are projected on the leading components where they are. A last pass over the fit list
   measures how far the covariance of the whitened vectors is from the identity.

Only matrices of the number of dimensions squared reach the driver or are broadcast, whatever the
number of rows; more than ``DIMENSIONS`` dimensions are refused.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry, or one whose
integer is no long, are left out; so are vectors of another length than most (of equally many the
longer length counts). Repeated rows and ids stay, a null id too. Components without variance
(fewer distinct vectors than dimensions, constant dimensions) cannot be whitened and are left out,
so a fit list of one vector gives no rows. Tied eigenvalues have any orthogonal basis, the same for
all rows. A deviation beyond a long is null. Empty tables give empty results. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.llm.common import saved

SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 16
DIMENSIONS = 1024
PER_SPECTRUM = 4096  # vectors of a partition, about
FAN_IN = 16
BATCH = 4096  # rows per matrix product
_EPS = np.finfo(float).eps
_LONG = 2**63 - 1


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(weights / (poles - x)), one behind each pole.

    Poles ascend, weights and rho are positive. Returns the nearer pole of each root (its number)
    and the matrix pole - root, whose entries are exact in the relative sense. Each step fits the
    two neighbouring poles of a root with the values and slopes of both sums; steps that leave the
    bracket of a root are replaced by halving it.
    """
    k = len(poles)
    ends = np.append(poles[1:], poles[-1] + rho * weights.sum())
    gap = ends - poles
    apart = poles[None, :] - poles[:, None]
    middle = 1.0 + rho * (1.0 / (apart - gap[:, None] / 2)) @ weights
    near_left = middle >= 0
    near_left[-1] = True
    base = np.arange(k) + ~near_left
    offset = poles[None, :] - poles[base][:, None]
    low = np.where(near_left, 0.0, -gap / 2)
    high = np.where(near_left, gap / 2, 0.0)
    high[-1] = gap[-1]
    mu = (low + high) / 2
    below_mask = np.tri(k)  # poles up to the root's own
    above_mask = 1.0 - below_mask
    live = np.arange(k)
    for _ in range(120):
        x, lo, hi = mu[live], low[live], high[live]
        delta = offset[live] - x[:, None]
        part = weights / delta
        slope = part / delta
        under, over = below_mask[live], above_mask[live]
        below, above = np.einsum("ij,ij->i", part, under), np.einsum("ij,ij->i", part, over)
        value = 1.0 / rho + below + above
        open_ = np.abs(value) > 8 * _EPS * (1.0 / rho - below + above)
        open_ &= hi - lo > 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi))
        if not open_.any():
            break
        lo, hi = np.where(value < 0, x, lo), np.where(value < 0, hi, x)
        slope_below, slope_above = np.einsum("ij,ij->i", slope, under), np.einsum("ij,ij->i", slope, over)
        own = np.arange(len(live))
        left, right = delta[own, live], delta[own, np.minimum(live + 1, k - 1)]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            c = value - left * slope_below - right * slope_above
            a = (left + right) * value - left * right * (slope_below + slope_above)
            b = left * right * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(live == k - 1, left + left * left * slope_below / (value - left * slope_below), step)
            new = x + step
        good = (new > lo) & (new < hi)  # no number is not good
        low[live], high[live] = lo, hi
        mu[live[open_]] = np.where(good, new, (lo + hi) / 2)[open_]
        live = live[open_]
    return base, offset - mu[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending values, vectors in columns) of V diag(values) V' + rho * direction direction'.

    Deflation: an eigenpair whose share of the direction is negligible stays as it is; of
    (nearly) equal values all but one are turned out of the direction first.
    """
    z = vectors.T @ direction
    size = float(z @ z)
    if not size > 0 or not rho > 0:
        return values, vectors
    limit = 8 * _EPS * max(float(np.abs(values[-1])), float(np.abs(values[0])), rho * size)
    active = np.flatnonzero(rho * np.abs(z) * np.sqrt(size) > limit)
    if not len(active):
        return values, vectors
    if len(active) > 1 and (np.diff(values[active]) <= 4 * limit).any():
        values, vectors, z = values.copy(), vectors.copy(), z.copy()
        for i, j in zip(active[:-1], active[1:]):
            r = float(np.hypot(z[i], z[j]))
            c, s = z[j] / r, z[i] / r
            if abs(c * s * (values[j] - values[i])) <= limit:
                z[j], z[i] = r, 0.0
                values[i], values[j] = c * c * values[i] + s * s * values[j], s * s * values[i] + c * c * values[j]
                vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
        active = active[z[active] != 0]
    active = active[np.argsort(values[active], kind="stable")]  # a rotation may swap two values
    poles, share, k = values[active], z[active], len(active)
    base, delta = secular_roots(poles, share * share, rho)
    # Weights for which the computed roots are exact; vectors from them are orthogonal.
    num, den = -delta, poles[:, None] - poles[None, :]
    i, j = np.indices((k, k))
    upper = np.vstack([den[1:], np.ones((1, k))])
    ratio = num / np.where(i < j, den, np.where(i < k - 1, upper, 1.0))
    weight = np.copysign(np.sqrt(np.maximum(ratio.prod(axis=0), 0.0)), share)
    inner = weight[None, :] / delta
    inner /= np.linalg.norm(inner, axis=1)[:, None]
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[active] = poles[base] - delta[np.arange(k), base]
    new_vectors[:, active] = vectors[:, active] @ inner.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


@dataclass
class Spectrum:
    """Eigenvalues (ascending) and vectors of the scatter of n vectors about their mean."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        """One vector more."""
        gap = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, gap, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + gap / self.n

    def join(self, other: Spectrum) -> None:
        """The vectors of another spectrum more."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        gap, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, gap, self.n / n * other.n)
        self.n, self.mean = n, self.mean + gap * (other.n / n)


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows whose vectors can be used, x less ``OFFSET``; and their number."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 2.0**56))  # not so for NaN
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    found = rows.filter(fine & (F.size(vector) > 0)).select(F.col(vec_id).alias("vec_id"), scaled.alias("x"))
    most = found.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size, n = (most["size"], most["n"]) if most else (0, 0)
    if size > DIMENSIONS:
        raise ValueError(f"{size} dimensions, more than {DIMENSIONS}")
    return found.filter(F.size("x") == size), n


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, one a row."""
    flat = batch["x"].flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch), -1) if len(batch) else np.zeros((0, 0), np.int64)


_SPECTRUM = "part long, n long, sums array<decimal(38,0)>, mean array<double>, spread array<double>, axes array<double>"


def _spectra(fit: DataFrame) -> DataFrame:
    """The spectrum of each partition of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = None, None
        for batch in batches:
            x = _matrix(batch)
            if not len(x):
                continue
            if found is None:
                found, sums = Spectrum.empty(x.shape[1]), [0] * x.shape[1]
            sums = [a + b for a, b in zip(sums, _exact_sums(x))]
            for row in x.astype(float):
                found.add(row)
        if found is not None:
            yield _packed(TaskContext.get().partitionId(), found, sums)

    return fit.select("x").mapInArrow(run, _SPECTRUM)


_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), *((c, pa.list_(pa.float64())) for c in ("mean", "spread", "axes"))])


def _packed(part: int, s: Spectrum, sums: list[int]) -> pa.RecordBatch:
    row = [[part], [s.n], [[Decimal(v) for v in sums]], [s.mean], [s.values], [s.vectors.ravel()]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)


def _unpacked(row) -> tuple[Spectrum, list[int]]:
    d = len(row["mean"])
    axes = np.asarray(row["axes"], float).reshape(d, d)
    return Spectrum(int(row["n"]), np.asarray(row["mean"], float), np.asarray(row["spread"], float), axes), [int(v) for v in row["sums"]]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One spectrum of all rows of a group, one row at a time."""
    total, sums, part = None, [], 0
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            s, more = _unpacked(row)
            if total is None:
                total, sums, part = s, more, row["part"]
            else:
                total.join(s)
                sums = [a + b for a, b in zip(sums, more)]
    if total is not None:
        yield _packed(part, total, sums)


def _exact_sums(x: np.ndarray) -> list[int]:
    if float(np.abs(x).max(initial=0)) * len(x) < 2**62:
        return x.sum(axis=0).tolist()
    return [int(v) for v in x.astype(object).sum(axis=0)]


@dataclass
class Model:
    """What whitening needs: count and exact sums of the fit list (less ``OFFSET``), components in columns by falling variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitener(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)


def incremental(fit: DataFrame) -> tuple[Spectrum, list[int]] | None:
    """Spectrum and exact sums of the fit list (x); None if it is empty."""
    spectra = saved(_spectra(fit), "spectra")
    last = spectra.agg(F.max("part")).first()[0]
    step = FAN_IN
    while last:
        groups = last // step + 1
        dealt = spectra.repartition(groups, F.floor(F.col("part") / step))
        spectra = saved(dealt.mapInArrow(_combine, _SPECTRUM), "spectra")
        if groups == 1:
            break
        step *= FAN_IN
    row = spectra.first()
    return _unpacked(row) if row else None


def _covariance(fit: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Covariance of the fit list in the basis, centred by the mean; a task holds one matrix."""
    shared = fit.sparkSession.sparkContext.broadcast((mean, basis))
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, axes = shared.value
        total, rows = np.zeros((k, k)), 0
        for batch in batches:
            x = _matrix(batch)
            rows += len(x)
            for a in range(0, len(x), BATCH):
                y = (x[a : a + BATCH] - middle) @ axes
                total += y.T @ y
        spots = np.arange(k * k if rows else 0)
        yield pa.RecordBatch.from_arrays([pa.array(spots), pa.array(total.ravel()[: len(spots)])], names=["at", "v"])

    rows = fit.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    shared.destroy()
    out = np.zeros(k * k)
    out[rows["at"].to_numpy()] = rows["v"].to_numpy()
    out = out.reshape(k, k) / n
    return (out + out.T) / 2


def fit(vectors: DataFrame, rows: int, components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors of (vec_id, x), which has ``rows`` rows; None without any."""
    parts = max(1, -(-rows // PER_SPECTRUM))
    distinct = saved(vectors.select("x").distinct().repartition(parts, "x"), "fit-list")
    found = incremental(distinct)
    if found is None:
        return None
    spectrum, sums = found
    basis = np.linalg.qr(spectrum.vectors)[0]
    model = Model(spectrum.n, sums, np.zeros(0), basis, 0.0)
    ritz = _covariance(distinct, model.mean, basis, model.n)
    values, turn = np.linalg.eigh(ritz)
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], basis @ turn[:, order]
    keep = int((values > max(values[0], 0) * len(values) * _EPS * 16).sum()) if values[0] > 0 else 0
    keep = min(keep, components)
    model = Model(model.n, sums, values[:keep], axes[:, :keep], float(np.trace(ritz)))
    if keep:
        seen = _covariance(distinct, model.mean, model.whitener(), model.n)
        model.identity_error = float(np.abs(seen - np.eye(keep)).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Exact sums over dimensions of (n * x - sum)^2; None beyond a long."""
    most = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if x.shape[1] * most * most < 2**62:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = n * x.astype(object) - np.array(sums, dtype=object)
    return [v if (v := int(g)) <= _LONG else None for g in (gap * gap).sum(axis=1)]


ROWS = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(vectors: DataFrame, model: Model | None) -> DataFrame:
    """Per row and component: its whitened coordinate, and the figures of the model."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], ROWS.format(kind))
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, mean, whitener = len(m.variances), m.mean, m.whitener()
        explained = m.variances / m.trace
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                part = batch.slice(a, BATCH)
                x = _matrix(part)
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    part["vec_id"].take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), m.n)),
                    pa.array(_deviations(x, m.n, m.sums), pa.int64()).take(pa.array(rows)), pa.array(((x - mean) @ whitener).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), m.identity_error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, ROWS.format(kind))


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every usable row."""
    vectors, n = integer_vectors(rows, vec_id, vector)
    return apply(vectors, fit(vectors, n, components))
