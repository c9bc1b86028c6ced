"""What plans move: packed real transforms, folds in the partitions, scans by segments, differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.grid import Grid
from gridframe.meta import ArrayMeta
from gridframe.operators import fold
from gridframe.operators.fold import Difference, Monoid, Reduce, Scan, max_of, min_of, sum_of
from gridframe.operators.spectral import FFT, rectangle
from gridframe.recipes import signals

RNG = np.random.default_rng(3)


@pytest.fixture
def moved(spark):
    """(rows, bytes) that each exchange of a frame writes, in the order of the plan."""

    def run(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            df = df.select("*")  # planned anew
            df.collect()
            found, waiting = [], [df._jdf.queryExecution().executedPlan()]
            while waiting:
                node = waiting.pop()
                if node.nodeName() == "Exchange":
                    found.append((node.metrics().get("shuffleRecordsWritten").get().value(), node.metrics().get("dataSize").get().value()))
                below = node.children()
                waiting += [below.apply(k) for k in range(below.size())]
            return found
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")

    return run


def names(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# ------------------------------------------------------------ real transforms


@pytest.mark.parametrize("n, most", [(64, 16), (48, 16), (36, 12), (100, 20), (98, 28), (8, 4), (22, 8), (202, 32)])
def test_packed_transforms_in_steps(spark, n, most):
    """Rectangles with even and odd sides, and lengths (22, 202) whose half has none."""
    x = RNG.normal(size=(3, n))
    grid = Grid.from_numpy(spark, x, "float64")
    half = signals.rfft(grid, max_lane=most)
    assert half.df.count() == 3 * (n // 2 + 1)
    assert np.allclose(half.to_numpy(), np.fft.rfft(x))
    noise = Grid.from_numpy(spark, np.fft.rfft(x) + 1j * RNG.normal(size=(3, n // 2 + 1)) * np.isin(np.arange(n // 2 + 1), [0, n // 2]), "complex128")
    assert np.allclose(signals.irfft(noise, max_lane=most).to_numpy(), x)


def test_a_rectangle_is_needed_for_steps(spark):
    with pytest.raises(ValueError):
        signals.irfft(Grid.from_numpy(spark, np.zeros((1, 102), complex), "complex128"), max_lane=16)
    assert rectangle(11, 4) is None and rectangle(101, 8) is None and rectangle(49, 14) == (7, 7)


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_real_lanes_move_half(spark, moved, most):
    """Against a complex transform of the same length."""
    x = Grid.from_numpy(spark, RNG.normal(size=(4, 1024)), "float64")
    z = x.with_value(F.struct(F.col("v").alias("re"), F.lit(0.0).alias("im")), "complex128")
    whole = sum(size for _, size in moved(FFT(z, axes=(1,), max_lane=most).call(input=z).df))
    half = sum(size for _, size in moved(signals.rfft(x, max_lane=most).df))
    assert half < 0.65 * whole
    spectrum = Grid.from_numpy(spark, np.fft.rfft(RNG.normal(size=(4, 1024))), "complex128")
    assert sum(size for _, size in moved(signals.irfft(spectrum, max_lane=most).df)) < 0.65 * whole


def test_antiperiodic_inverse_does_not_pad(spark, moved):
    x = RNG.normal(size=(2, 512))
    there = Grid.from_numpy(spark, np.fft.fft(np.concatenate([x, -x], axis=-1), axis=-1)[..., 1:512:2], "complex128")
    back = signals.iaprfft(there)
    assert np.allclose(back.to_numpy(), x)
    assert sum(n for n, _ in moved(back.df)) <= 2 * 256  # at most an element a row, also before it is aggregated
    assert np.allclose(signals.iaprfft(there, max_lane=64).to_numpy(), x)


# ------------------------------------------------------------ folds


def affine(p=10_007):
    """Composition of maps x -> a x + b, which does not commute."""
    m = F.lit(p).cast("bigint")
    return Monoid(lambda x, y: F.struct(F.pmod(x["a"] * y["a"], m).alias("a"), F.pmod(x["b"] * y["a"] + y["b"], m).alias("b")), {"a": 1, "b": 0}, "struct<a:bigint,b:bigint>")


def maps(spark, n, partitions, shuffled):
    df = spark.range(0, n, 1, partitions)
    df = df.repartition(partitions, F.xxhash64("id")) if shuffled else df
    return Grid(df.select(F.col("id").alias("i0"), F.struct((F.col("id") % 7 + 1).alias("a"), (F.col("id") % 5).alias("b")).alias("v")), ArrayMeta((n,), "struct<a:bigint,b:bigint>"))


@pytest.mark.parametrize("partitions, shuffled", [(1, False), (7, False), (5, True)])
def test_ordered_folds_in_partitions(spark, monkeypatch, partitions, shuffled):
    monkeypatch.setattr(fold, "PACK_ROWS", 100)
    grid = maps(spark, 1000, partitions, shuffled)
    want = (1, 0)
    for k in range(1000):
        want = want[0] * (k % 7 + 1) % 10_007, (want[1] * (k % 7 + 1) + k % 5) % 10_007
    got = Reduce(grid, affine()).call(input=grid).df.first()["v"]
    assert (got["a"], got["b"]) == want


@pytest.mark.parametrize("commutative", [False, True])
def test_partitions_by_groups_are_shuffled(spark, moved, commutative):
    n, parts = 60_000, 6
    product = Monoid(lambda a, b: F.pmod(a * b, F.lit(1_000_003).cast("bigint")), 1, "int64", commutative=commutative)
    df = spark.range(0, n, 1, parts).select((F.col("id") % 3).alias("i0"), F.call_function("div", F.col("id"), F.lit(3).cast("bigint")).alias("i1"), (F.col("id") % 97 + 1).alias("v"))
    grid = Grid(df, ArrayMeta((3, n // 3), "int64"))
    out = Reduce(grid, product, axes=(1,)).call(input=grid)
    values = np.arange(n) % 97 + 1
    want = [1, 1, 1]
    for k, v in enumerate(values.tolist()):
        want[k % 3] = want[k % 3] * v % 1_000_003
    assert out.to_numpy().ravel().tolist() == want
    assert max(rows for rows, _ in moved(out.df)) <= 3 * parts


def test_commutative_folds_of_scattered_places(spark, moved):
    """Places of a group that are anywhere still give one row a partition."""
    product = Monoid(lambda a, b: F.pmod(a * b, F.lit(101).cast("bigint")), 1, "int64", commutative=True)
    df = spark.range(0, 5000, 1, 4).repartition(4, F.xxhash64("id")).select(F.col("id").alias("i0"), (F.col("id") % 13 + 1).alias("v"))
    grid = Grid(df, ArrayMeta((5000,), "int64"))
    out = Reduce(grid, product).call(input=grid).df
    want = 1
    for k in range(5000):
        want = want * (k % 13 + 1) % 101
    assert out.first()["v"] == want
    assert sorted(rows for rows, _ in moved(out))[0] <= 4


# ------------------------------------------------------------ scans


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("make", ["sum", "max", "min", "complex", "generic"])
def test_scans_by_segments(spark, partitions, exclusive, make):
    n = 700
    x = RNG.integers(-50, 50, (2, n))
    if make == "generic":
        grid = maps(spark, n, partitions, True)
        got = [(r["v"]["a"], r["v"]["b"]) for r in Scan(grid, affine(), exclusive=exclusive, block=32).call(input=grid).df.orderBy("i0").collect()]
        want, state = [], (1, 0)
        for k in range(n):
            after = state[0] * (k % 7 + 1) % 10_007, (state[1] * (k % 7 + 1) + k % 5) % 10_007
            want.append(state if exclusive else after)
            state = after
        assert got == want
        return
    dtype, monoid, accumulate, empty = {
        "sum": ("int64", sum_of("int64"), np.add, 0), "max": ("int64", max_of("int64", -99), np.maximum, -99), "min": ("int64", min_of("int64", 99), np.minimum, 99), "complex": ("complex128", sum_of("complex128"), np.add, 0),
    }[make]
    x = x + 1j * x[::-1] if make == "complex" else x
    grid = Grid.from_numpy(spark, x, dtype)
    grid = Grid(grid.df.repartition(partitions, F.xxhash64("i1")), grid.meta)
    want = accumulate.accumulate(x, axis=1)
    if exclusive:
        want = np.concatenate((np.full((2, 1), empty, want.dtype), want[:, :-1]), axis=1)
    out = Scan(grid, monoid, axes=(1,), exclusive=exclusive, block=32).call(input=grid)
    assert np.allclose(out.to_numpy(), want)


def test_a_scan_has_no_window_and_no_join(spark):
    for grid, monoid in ((Grid.from_numpy(spark, np.arange(500), "int64"), sum_of("int64")), (maps(spark, 500, 3, False), affine())):
        plan = names(Scan(grid, monoid, block=16).call(input=grid).df)
        assert "Window" not in plan and "Join" not in plan


def test_a_long_lane_moves_once(spark, moved):
    grid = Grid(spark.range(0, 50_000, 1, 5).select(F.col("id").alias("i0"), (F.col("id") % 11).alias("v")), ArrayMeta((50_000,), "int64"))
    out = Scan(grid, sum_of("int64"), block=64).call(input=grid)
    assert np.array_equal(out.to_numpy(), np.cumsum(np.arange(50_000) % 11))
    rows = sorted(n for n, _ in moved(out.df))
    assert rows[-1] < 50_000 + 1100 and sum(rows[:-1]) < 9_000  # segments' totals and starts besides


@pytest.mark.parametrize("dtype", ["int32", "float32", "uint64", "uint32"])
def test_scans_of_other_kinds(spark, dtype):
    x = RNG.integers(0, 9, 40)
    grid = Grid.from_numpy(spark, x, "int64")
    grid = grid.with_value(F.col("v").cast({"int32": "int", "float32": "float", "uint64": "decimal(20,0)", "uint32": "bigint"}[dtype]), dtype)
    out = Scan(grid, sum_of(dtype), block=8).call(input=grid).df.orderBy("i0").collect()
    assert [int(r["v"]) for r in out] == np.cumsum(x).tolist()


# ------------------------------------------------------------ differences


@pytest.mark.parametrize("axes", [(0,), (1,), (1, 0), None])
def test_differences_undo_scans(spark, axes):
    x = RNG.integers(-9, 9, (7, 13))
    grid = Grid.from_numpy(spark, x, "int64")
    there = Scan(grid, sum_of("int64"), axes=axes, block=4).call(input=grid)
    assert np.array_equal(Difference(there, sum_of("int64"), axes=axes, block=4).call(input=there).to_numpy(), x)
    with pytest.raises(ValueError):
        Difference(grid, max_of("int64", 0), axes=axes)


def test_differences_move_borders_only(spark, moved):
    grid = Grid(spark.range(0, 1000, 1, 3).select(F.col("id").alias("i0"), (F.col("id") * F.col("id")).alias("v")), ArrayMeta((1000,), "int64"))
    out = Difference(grid, sum_of("int64"), block=100).call(input=grid)
    assert np.array_equal(out.to_numpy(), np.diff(np.arange(1000) ** 2, prepend=0))
    assert [rows for rows, _ in moved(out.df)] == [1010]
