import math

import numpy as np
import pytest

from sitelore.llm import whitening
from sitelore.llm.spectra import Spectrum, rank_one

SCHEMA = "vec_id long, embedding array<float>, n long, x int, component string"


@pytest.mark.parametrize("dims", [1, 2, 5, 20])
@pytest.mark.parametrize("shape", ["plain", "flat", "whole", "few"])
def test_spectra_equal_the_eigenpairs_of_the_scatter(dims, shape):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(120, dims))
    if shape == "flat":
        x[:, : dims // 2] = 0  # deflation of untouched directions
    elif shape == "whole":
        x = np.rint(x)
    elif shape == "few":
        x = np.repeat(x[:3], 40, axis=0)  # deflation of equal eigenvalues
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    one, a, b = (Spectrum.empty(dims) for _ in range(3))
    for i, row in enumerate(x):
        one.add(row)
        (a if i < 50 else b).add(row)
    a.merge(b)
    for s in (one, a):
        assert s.n == 120 and np.allclose(s.mean, x.mean(0))
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(dims), atol=1e-12)
        assert np.allclose(s.vectors * s.values @ s.vectors.T, scatter, atol=1e-11 * max(1, np.abs(scatter).max()))
        assert (np.diff(s.values) >= 0).all()


def test_one_change_of_distinct_and_equal_values():
    for values in ([1.0, 2.0, 4.0], [1.0, 1.0, 4.0], [0.0, 0.0, 0.0], [1.0, 1.0 + 1e-15, 1e8]):
        for change in ([1.0, 1.0, 1.0], [0.0, 3.0, 0.0], [1e-9, 1.0, 1e9], [0.0, 0.0, 0.0]):
            values, change = np.array(values), np.array(change)
            new, q = rank_one(values, np.eye(3), change, 0.5)
            want = np.diag(values) + 0.5 * np.outer(change, change)
            assert np.allclose((q * new) @ q.T, want, rtol=1e-12, atol=1e-13 * np.abs(want).max())


def whitened_by_hand(data):
    """Rows by numpy's covariance and eigh."""
    use = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v, *_ in data
           if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in use})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], dtype=float) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    out = {}
    for i, x in use:
        whole = [n * a - s for a, s in zip(x, sums)]
        y = np.array(whole, dtype=float) / n @ u[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300))
        out.setdefault(i, []).append((n, sum(w * w for w in whole), y, e[::-1] / e.sum()))
    return out


def data(n=300, dims=20, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * np.linspace(0.3, 2, dims) + rng.normal(size=dims)
    rows = [(i, [float(np.float32(c)) for c in v], 5, 6, "c") for i, v in enumerate(x)]
    rows += [rows[7]] * 40 + [(None, rows[8][1], 1, 1, None)]
    odd = [None, [None] * dims, [float("nan")] * dims, [1.0] * (dims - 1) + [float("inf")], []]
    return rows + [(1000 + i, v, 1, 1, "") for i, v in enumerate(odd)]


def test_equals_whitening_by_hand(spark):
    rows = data()
    want = whitened_by_hand(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * (300 + 40 + 1)
    signs = {}
    for r in got:
        n, far, y, part = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, far) and r.identity_error < 1e-10
        assert math.isclose(r.explained, part[r.component - 1], rel_tol=1e-10)
        assert math.isclose(abs(r.whitened), abs(y[r.component - 1]), rel_tol=1e-7, abs_tol=1e-8)
        if abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * y[r.component - 1] > 0)
    assert set(signs) == set(range(1, 17)) and all(len(s) == 1 for s in signs.values())


def test_lengths_apart_and_no_variance(spark):
    rows = [(i, [float(i % 5), float(i * i % 7)], 1, 1, "") for i in range(30)]
    rows += [(100 + i, [float(i), 2.0, 3.0], 1, 1, "") for i in range(4)] + [(200, [1.0] * 4, 1, 1, "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.vec_id >= 100, r.component) for r in got} == {(False, 1), (False, 2), (True, 1)}
    line = sorted((r.vec_id, r.whitened) for r in got if r.vec_id >= 100)
    assert np.allclose(np.abs(np.diff([w for _, w in line])), 1 / np.sqrt(1.25))
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", *[c.split()[0] for c in whitening._OUT.split(", ")]]


def test_huge_entries_do_not_fail(spark):
    rows = [(0, [3e38, 1.0], 1, 1, ""), (1, [-3e38, 2.0], 1, 1, ""), (2, [0.0, 0.5], 1, 1, "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in got} == {0: None, 1: None, 2: 16384}
    assert all(np.isfinite(r.whitened) for r in got)
