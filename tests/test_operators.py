"""Operators against numpy on small arrays."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.functions import transforms as T
from gridframe.grid import Grid
from gridframe.meta import ArrayMeta, array
from gridframe.operators import fold
from gridframe.operators.fold import Monoid, Reduce, Scan, sum_of
from gridframe.operators.linear import EntrywiseNorm, MatrixMul
from gridframe.operators.pure import PureParallel
from gridframe.operators.rearrange import FFTShift, Roll, Transpose
from gridframe.operators.spectral import DHT, FFT, gauss_hermite
from gridframe.recipes import signals
from gridframe.streaming.elementwise import apply_to_stream

RNG = np.random.default_rng(5)
WHOLE = RNG.integers(0, 100, (5, 7, 3))
PRODUCT = Monoid(lambda a, b: F.pmod(a * b, F.lit(1009).cast("bigint")), 1, "int64")


@pytest.fixture(scope="module")
def grid(spark):
    return Grid.from_numpy(spark, WHOLE, "int64")


def same(got, want, tol=0.0):
    got = got.to_numpy()
    assert got.shape == want.shape
    assert np.allclose(got, want, rtol=tol, atol=tol) if tol else np.array_equal(got, want)


@pytest.mark.parametrize("axes", [None, (1, 0, 2), (2, 0, 1)])
def test_transpose(grid, axes):
    same(Transpose(grid, axes).call(input=grid), WHOLE.transpose(axes))


@pytest.mark.parametrize("shift", [4, -9, 0, 100])
@pytest.mark.parametrize("axis", [-1, 0, 1])
def test_roll(grid, shift, axis):
    same(Roll(grid, axis).call(input=grid, shift=shift), np.roll(WHOLE, shift, axis))


@pytest.mark.parametrize("axes", [None, (0,), (2, 0)])
def test_shift(grid, axes):
    op = FFTShift(grid, axes)
    same(op.call(input=grid), np.fft.fftshift(WHOLE, axes))
    same(op.call(input=grid, inverse=1), np.fft.ifftshift(WHOLE, axes))


def test_projections_do_not_shuffle(grid):
    plan = Roll(grid).call(input=Transpose(grid, (0, 2, 1)).call(input=grid).reshape((5, 7, 3)), shift=1).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("axes", [None, (0,), (0, 2), (-1,), ()])
def test_reduce(grid, axes):
    want = WHOLE if axes == () else WHOLE.sum(axis=axes, keepdims=True)
    same(Reduce(grid, sum_of("int64"), axes).call(input=grid), want)


def test_reduce_monoid_in_blocks(grid, monkeypatch):
    monkeypatch.setattr(fold, "BLOCK", 4)
    lanes = WHOLE.transpose(1, 0, 2).reshape(7, -1)
    want = [functools.reduce(lambda a, b: a * b % 1009, row, 1) for row in lanes.tolist()]
    same(Reduce(grid, PRODUCT, (0, 2)).call(input=grid), np.array(want).reshape(1, 7, 1))


@pytest.mark.parametrize("block", [3, 100])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("monoid", ["sum", "product"])
def test_scan(grid, block, exclusive, monoid):
    lanes = WHOLE.transpose(1, 2, 0).reshape(7, 15)
    if monoid == "sum":
        op, want, first = sum_of("int64"), lanes.cumsum(axis=1), 0
    else:
        op, first = PRODUCT, 1
        want = np.array([functools.reduce(lambda acc, x: [*acc, acc[-1] * x % 1009], row, [1])[1:] for row in lanes.tolist()])
    if exclusive:
        want = np.concatenate([np.full((7, 1), first), want[:, :-1]], axis=1)
    same(Scan(grid, op, axes=(2, 0), exclusive=exclusive, block=block).call(input=grid), want.reshape(7, 3, 5).transpose(2, 0, 1))


@pytest.mark.parametrize("tiled", [False, True])
def test_matmul(spark, tiled):
    options = {"tile": 2, "tile_from": 0} if tiled else {}
    a, b = RNG.normal(size=(3, 4, 5)), RNG.normal(size=(6, 5)) + 1j * RNG.normal(size=(6, 5))
    ga, gb = Grid.from_numpy(spark, a), Grid.from_numpy(spark, b)
    same(MatrixMul(ga, gb, transposed_b=True, **options).call(matrix_a=ga, matrix_b=gb), a @ b.T, 1e-9)
    w = Grid.from_numpy(spark, WHOLE[:3, :5, :2].astype("int64"))
    same(MatrixMul(w, w, transposed_a=True, **options).call(matrix_a=w, matrix_b=w), WHOLE[:3, :5, :2].transpose(0, 2, 1) @ WHOLE[:3, :5, :2])


def test_matmul_rejects_sizes():
    with pytest.raises(ValueError):
        MatrixMul(ArrayMeta((3, 4), "float64"), ArrayMeta((5, 6), "float64"))


@pytest.mark.parametrize("order", [0.5, 1, 2, 3])
def test_norm(spark, order):
    z = RNG.normal(size=(4, 3)) + 1j * RNG.normal(size=(4, 3))
    grid = Grid.from_numpy(spark, z)
    same(EntrywiseNorm(grid, order, (1,)).call(input=grid), (abs(z) ** order).sum(axis=1, keepdims=True) ** (1 / order), 1e-9)


@pytest.mark.parametrize("max_lane", [1 << 20, 5])
@pytest.mark.parametrize("n", [12, 7, 1])
def test_fft(spark, max_lane, n):
    z = RNG.normal(size=(3, n)) + 1j * RNG.normal(size=(3, n))
    grid = Grid.from_numpy(spark, z)
    op = FFT(grid, axes=(1,), max_lane=max_lane)
    same(op.call(input=grid), np.fft.fft(z, axis=1), 1e-9)
    same(op.call(input=grid, inverse=1), np.fft.ifft(z, axis=1), 1e-9)


def test_fft_needs_complex():
    with pytest.raises(ValueError, match="complex"):
        FFT(ArrayMeta((4,), "float64"))


def test_dht(spark):
    roots, weights = gauss_hermite(9)
    want = np.polynomial.hermite.hermgauss(9)
    assert np.allclose(roots, want[0]) and np.allclose(weights, want[1] * np.exp(want[0] ** 2))
    modes = RNG.normal(size=(4, 5))
    grid = Grid.from_numpy(spark, modes)
    coords = DHT(grid, inverse=True).call(modes=grid)
    same(DHT(grid).call(coords=coords), modes, 1e-9)


def test_signals(spark):
    s = RNG.normal(size=60)
    grid = Grid.from_numpy(spark, s)
    frames = np.array([s[k * 4 : k * 4 + 12] for k in range(13)]) * np.hanning(12)
    same(signals.spectrogram(grid, 12, 8, 16), abs(np.fft.fft(np.pad(frames, ((0, 0), (0, 4))), axis=1))[:, :9].T, 1e-9)
    half = signals.rfft(grid)
    same(half, np.fft.rfft(s), 1e-9)
    same(signals.irfft(half), s, 1e-9)
    x = RNG.normal(size=(2, 16))
    same(signals.aprfft(Grid.from_numpy(spark, x)), np.fft.fft(np.concatenate([x, -x], axis=1), axis=1)[:, 1:16:2], 1e-9)


def test_pure_parallel(grid):
    def code(k):
        k.output.store_same(k.input.load_idx(k.idxs[0], F.lit(6) - k.idxs[1], k.idxs[1]))

    op = PureParallel([array("output", (5, 3), "int64", "o"), array("input", (5, 7, 3), "int64")], code)
    same(op.call(input=grid), np.stack([WHOLE[:, 6 - j, j] for j in range(3)], axis=1))


def test_combined_indices(grid):
    def code(k):
        k.output.store_same(k.input.load_combined_idx((2, 1), k.idxs[0], k.idxs[1]))

    op = PureParallel([array("output", (35, 3), "int64", "o"), array("input", (5, 7, 3), "int64")], code)
    same(op.call(input=grid), WHOLE.reshape(35, 3))


def test_density(spark, grid):
    grid.check_dense()
    with pytest.raises(ValueError):
        Grid(grid.df.where("i0 > 0"), grid.meta).check_dense()
    with pytest.raises(ValueError):
        Grid(grid.df.union(grid.df.limit(1)), grid.meta).check_dense()


def test_stream(spark, grid, tmp_path):
    grid.df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(grid.df.schema).parquet(str(tmp_path / "in"))
    out = apply_to_stream(stream, grid.meta, Roll(grid), "input", shift=2)
    query = out.writeStream.format("memory").queryName("rolled").start()
    query.processAllAvailable()
    query.stop()
    same(Grid(spark.table("rolled"), grid.meta), np.roll(WHOLE, 2, -1))


def test_struct_constant(spark):
    meta = ArrayMeta((2,), "struct<a:int,b:bigint>")
    rows = PureParallel.from_trf(T.broadcast_const(meta, {"a": 1, "b": 2})).call().df.collect()
    assert [tuple(r["v"]) for r in rows] == [(1, 2)] * 2
