import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canvasser.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"
SMALL = st.integers(-3, 3).map(float)


@st.composite
def updates(draw):
    d = draw(st.integers(1, 7))
    return d, draw(st.lists(st.lists(SMALL, min_size=d, max_size=d), min_size=1, max_size=14))


@settings(max_examples=300, deadline=None)
@given(updates())
def test_spectrum_of_few_vectors(given):
    """Few small integers: equal values, zero weights and repeated vectors abound."""
    d, rows = given
    x = np.array(rows)
    s = whitening.Spectrum.empty(d)
    for row in x:
        s.add(row)
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    top = max(1.0, np.abs(scatter).max())
    assert s.n == len(x) and np.allclose(s.mean, x.mean(0))
    assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
    assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() < 1e-11 * top
    assert np.abs(np.linalg.eigvalsh(scatter) - s.values).max() < 1e-11 * top


@pytest.mark.parametrize("cut", [0, 1, 40, 299, 300])
def test_spectra_are_combined(cut):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(300, 24)) * np.geomspace(1e-3, 1e4, 24)) + 1000
    parts = []
    for rows in (x[:cut], x[cut:]):
        s = whitening.Spectrum.empty(24)
        for row in rows:
            s.add(row)
        parts.append(s)
    parts[0].join(parts[1])
    want = np.linalg.eigvalsh((x - x.mean(0)).T @ (x - x.mean(0)))
    assert parts[0].n == 300 and np.allclose(parts[0].mean, x.mean(0))
    assert np.abs(parts[0].values - want).max() < 1e-13 * want.max()


def test_secular_roots_keep_small_gaps():
    poles, weights = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-18, 0.3, 1e-4, 2.0])
    base, delta = whitening.secular_roots(poles, weights, 0.7)
    roots = poles[base] - delta[np.arange(4), base]
    assert (roots[:-1] >= poles[:-1]).all() and (roots[:-1] <= poles[1:]).all() and roots[-1] > poles[-1]
    value = 1 + 0.7 * (weights / delta).sum(axis=1)
    assert np.abs(value / (1 + 0.7 * np.abs(weights / delta).sum(axis=1))).max() < 1e-14


def brute_force(rows, components=16):
    usable = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [tuple(int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v) for _, v in usable]
    fit = np.array(sorted(set(x)), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    mean = np.array([int(v) / n for v in s])
    gap = fit.astype(float) - mean
    cov = gap.T @ gap / n
    values, vectors = np.linalg.eigh(cov)
    out = []
    for (k, _), v in zip(usable, x):
        dev = sum((n * a - int(b)) ** 2 for a, b in zip(v, s))
        for c in range(min(components, len(mean))):
            at = len(mean) - 1 - c
            if values[at] > 1e-9 * values[-1]:
                out.append((k, c + 1, n, dev, abs((np.array(v, float) - mean) @ vectors[:, at]) / np.sqrt(values[at]), values[at] / np.trace(cov)))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], round(r[4], 6))
    got = sorted(((*tuple(r)[:4], abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9, atol=1e-9)


def test_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 20)) * np.geomspace(0.05, 3, 20)
    x[:, 3] = 0.25
    x[600:] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    frame = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA + ", x string, n int")
    got = whitening.whiten(frame.repartition(9)).collect()
    same(got, brute_force(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(1, 17):  # one sign for all rows
        mine = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c])
        ints = np.floor(64 * x)
        assert abs(np.corrcoef(mine, (ints - ints.mean(0)) @ np.linalg.lstsq(ints - ints.mean(0), mine - mine.mean(), rcond=None)[0])[0, 1]) > 1 - 1e-9


def test_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PER_SPECTRUM", 20)
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(8)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(500, 5)))]
    same(whitening.whiten(spark.createDataFrame(rows, SCHEMA), 3).collect(), brute_force(rows, 3))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, -3.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [9.0, 4.5]), (9, [1e300, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    same(got, brute_force([r for r in rows if r[0] in (1, None, 8)]))
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.filter("false")).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "vec_id string, embedding array<float>")).count() == 2


def test_deviations_are_exact():
    x = np.array([[2**40, -(2**40)], [3, 5], [2**30, 7]], np.int64)
    sums = [int(v) for v in x.sum(axis=0)]
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening._deviations(x, 3, sums) == [v if v < 2**63 else None for v in want] and want[0] > 2**63
    small = x[1:] % 1000
    assert whitening._deviations(small, 2, small.sum(axis=0).tolist()) == [sum((2 * int(a) - int(s)) ** 2 for a, s in zip(r, small.sum(axis=0))) for r in small]
