"""Chunked arrays against their element form and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.chunks import Chunks
from gridframe.grid import Grid
from gridframe.operators.fold import Monoid, max_of, min_of, sum_of
from gridframe.operators.linear import MatrixMul

RNG = np.random.default_rng(11)


def cut(spark, x, chunk, dtype=None):
    return Chunks.from_grid(Grid.from_numpy(spark, x, dtype), chunk)


@pytest.mark.parametrize("shape, chunk", [((7,), (3,)), ((6, 5), (2, 5)), ((5, 7, 4), (2, 3, 4)), ((3, 4), (9, 1)), ((2, 3, 2, 5), (1, 2, 2, 3))])
def test_there_and_back(spark, shape, chunk):
    x = RNG.integers(-9, 9, shape)
    one = cut(spark, x, chunk)
    assert np.array_equal(one.to_grid().to_numpy(), x)
    assert one.df.count() == np.prod(one.counts)
    other = tuple(min(n, c + 1) for n, c in zip(shape, chunk))
    assert np.array_equal(one.rechunk(other).to_grid().to_numpy(), x)
    for axes in (None, tuple(np.roll(range(len(shape)), 1).tolist())):
        assert np.array_equal(one.transpose(axes).to_grid().to_numpy(), x.transpose(axes))


def test_moves_of_blocks_alone(spark):
    """Whole lanes change their place only: no shuffle and no Python."""
    x = RNG.normal(size=(4, 6))
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, lane array<double>")
    lanes = Chunks.from_lanes(df, ["id"], "lane", x.shape, "float64")
    turned = lanes.transpose()
    plan = turned.df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan
    assert np.allclose(turned.to_grid().to_numpy(), x.T) and np.allclose(lanes.to_grid().to_numpy(), x)


@pytest.mark.parametrize("axes", [None, (0,), (1,), (0, 2)])
def test_folds(spark, axes):
    x = RNG.integers(-99, 99, (5, 7, 4))
    one = cut(spark, x, (2, 3, 4))
    for monoid, f in ((sum_of("int64"), np.sum), (max_of("int64", -100), np.max), (min_of("int64", 100), np.min)):
        assert np.array_equal(one.reduce(monoid, axes).to_numpy(), f(x, axis=axes, keepdims=True))
    z = x + 1j * x[::-1]
    assert np.allclose(cut(spark, z, (2, 3, 4), "complex128").reduce(sum_of("complex128"), axes).to_numpy(), z.sum(axis=axes, keepdims=True))
    product = Monoid(lambda a, b: F.pmod(a * b, F.lit(101).cast("bigint")), 1, "int64", commutative=True)
    got = one.reduce(product, axes).to_numpy()
    want = np.ones_like(got)
    for at in np.ndindex(*x.shape):
        out = tuple(0 if axes is None or k in axes else i for k, i in enumerate(at))
        want[out] = want[out] * x[at] % 101
    assert np.array_equal(got, want)


@pytest.mark.parametrize("axis", [0, 1, -1])
@pytest.mark.parametrize("inverse", [False, True])
def test_transforms(spark, axis, inverse):
    x = RNG.normal(size=(6, 8, 5)) + 1j * RNG.normal(size=(6, 8, 5))
    want = (np.fft.ifft if inverse else np.fft.fft)(x, axis=axis)
    for chunk in ((6, 8, 5), (2, 3, 2)):
        assert np.allclose(cut(spark, x, chunk, "complex128").fft(axis, inverse).to_grid().to_numpy(), want)
    assert np.allclose(cut(spark, x, (2, 3, 2), "complex128").fft(1, inverse, most=4).to_grid().to_numpy(), (np.fft.ifft if inverse else np.fft.fft)(x, axis=1))
    with pytest.raises(ValueError):
        cut(spark, x.real, (2, 3, 2)).fft(axis)


@pytest.mark.parametrize("dtype", ["int64", "float64", "complex128", "float32"])
@pytest.mark.parametrize("tile", [4, 3])
def test_products(spark, dtype, tile):
    a, b = RNG.integers(-9, 9, (7, 50)), RNG.integers(-9, 9, (50, 6))
    a, b = (a + 1j * a[::-1], b) if dtype == "complex128" else (a.astype(dtype), b.astype(dtype))
    one, two = cut(spark, a, (2, 9), dtype), cut(spark, b, (50, 1), "int64" if dtype in ("int64", "complex128") else dtype)
    out = one.matmul(two, tile)
    assert np.allclose(out.to_grid().to_numpy(), a @ b)
    again = out.transpose().matmul(out, tile)  # blocks that are tiles
    assert np.allclose(again.to_grid().to_numpy(), (a @ b).T @ (a @ b))


def test_only_sums_leave_the_tiles(spark):
    """The contracted index in segments, whose sums are added; batches piecewise and one for all."""
    x, y = RNG.integers(-9, 9, (3, 5, 80)), RNG.integers(-9, 9, (80, 6))
    a, b = Grid.from_numpy(spark, x, "int64"), Grid.from_numpy(spark, y, "int64")
    out = MatrixMul(a, b, tile=4, tile_from=1).call(matrix_a=a, matrix_b=b)
    assert np.array_equal(out.to_numpy(), x @ y)
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    one, gram = Chunks.from_grid(a.reshape((15, 80)), (15, 1)), x.reshape(15, 80)
    assert np.array_equal(one.matmul(one.transpose(), 16).to_grid().to_numpy(), gram @ gram.T)


def test_empty_tiles_and_small_ones(spark):
    a, b = RNG.normal(size=(1, 1)), RNG.normal(size=(1, 3))
    assert np.allclose(cut(spark, a, (1, 1)).matmul(cut(spark, b, (1, 2))).to_grid().to_numpy(), a @ b)
    with pytest.raises(ValueError):
        cut(spark, a, (1, 1)).matmul(cut(spark, b.T, (1, 1)))
    with pytest.raises(ValueError):
        Chunks(cut(spark, a, (1, 1)).df, cut(spark, a, (1, 1)).meta, (0, 1))
