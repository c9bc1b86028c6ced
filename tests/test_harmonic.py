"""Roots by number, functions out of the range of doubles, and the transform by generated tiles."""

import numpy as np
import pytest

from gridframe.grid import Grid
from gridframe.operators import spectral
from gridframe.operators.spectral import DHT, gauss_hermite, hermite_functions, hermite_roots


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 17, 64, 101, 200])
def test_roots_are_those_of_the_polynomial(n):
    roots, weights = gauss_hermite(n)
    want, w = np.polynomial.hermite.hermgauss(n)
    assert np.allclose(roots, want, atol=1e-12) and np.allclose(weights * np.exp(-(roots**2)), w, atol=1e-13)


def test_many_roots():
    """Against the eigenvalues of the recurrence, and each by itself."""
    n = 1500
    off = np.sqrt(np.arange(1, n) / 2.0)
    want = np.linalg.eigvalsh(np.diag(off, 1) + np.diag(off, -1))
    assert np.allclose(hermite_roots(n, np.arange(n)), want, atol=1e-9)
    assert np.allclose(hermite_roots(n, np.array([1499, 0, 750])), want[[1499, 0, 750]], atol=1e-9)


def test_a_block_of_20000_roots():
    """Alternating signs of the derivative, and distances as the phase says, at both ends and in the middle."""
    n = 20_000
    for first in (0, 9_990, n - 20):
        x = hermite_roots(n, np.arange(first, first + 20))
        below, own = spectral.hermite_pair(n, x)
        assert (np.diff(x) > 0).all() and (np.abs(own) < 1e-6 * np.abs(below)).all()
        assert (below[1:] * below[:-1] < 0).all()
        assert abs(x[10]) < np.sqrt(2 * n + 1)


def test_functions_stay_in_range():
    """Orthonormal at modes whose exponential is 0 in doubles."""
    n = 1200
    x, w = gauss_hermite(n)
    assert np.exp(-(x[0] ** 2) / 2) == 0
    p = hermite_functions(n, x)
    some = [0, 1, 600, 1198, 1199]
    assert np.allclose((p[some] * w) @ p[some].T, np.eye(5), atol=1e-9)


@pytest.mark.parametrize("dtype", ["float64", "complex128"])
def test_tiles_give_the_transform_of_the_matrix(spark, monkeypatch, dtype):
    monkeypatch.setattr(spectral, "SMALL_MATRIX", 0)
    rng = np.random.default_rng(2)
    for modes, order, add in ((300, 1, 0), (40, 2, 3)):
        size = spectral.spatial_points(modes, order, add)
        x = rng.normal(size=(2, size)) + (1j * rng.normal(size=(2, size)) if dtype == "complex128" else 0)
        there = DHT(Grid.from_numpy(spark, np.zeros((2, modes), x.dtype), dtype), add_points=(0, add), order=order, axes=(1,))
        coords = Grid.from_numpy(spark, x, dtype)
        got = there.call(coords=coords)
        assert np.allclose(got.to_numpy(), x @ spectral.dht_matrix(modes, order, add, False))
        if order == 1:
            back = DHT(got, add_points=(0, add), inverse=True, axes=(1,)).call(modes=got)
            assert np.allclose(back.to_numpy(), x)


def test_the_driver_makes_no_large_matrix(spark, monkeypatch):
    """2,000 modes: neither the matrix nor all roots are computed where the plan is made."""
    monkeypatch.setattr(spectral, "dht_matrix", None)
    monkeypatch.setattr(spectral, "gauss_hermite", lambda *a: pytest.fail("roots on the driver"))
    meta = spectral.ArrayMeta((1, 2_000), "float64")
    op = DHT(meta, axes=(1,))
    assert op.call(coords=Grid(spark.range(2_000).selectExpr("0L AS i0", "id AS i1", "double(id) AS v"), meta)).meta.shape == (1, 2_000)
