"""Plans that are cut: real transforms in steps, tiles, chunked prefixes, large constants, counters by arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.grid import Grid
from gridframe.meta import ArrayMeta, array
from gridframe.operators.fold import Monoid, Scan
from gridframe.operators.linear import MatrixMul
from gridframe.operators.pure import PureParallel
from gridframe.plans import kernel
from gridframe.random.cbrng import CBRNG, counter_steps
from gridframe.random.generators import SAMPLERS, Bijection, KeyGenerator, State, draws, seed_key
from gridframe.recipes import signals

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("n", [8, 12, 64])
@pytest.mark.parametrize("max_lane", [16, 1 << 20])
def test_real_transforms(spark, n, max_lane):
    x = RNG.normal(size=(3, n))
    grid = Grid.from_numpy(spark, x, "float64")
    half = signals.rfft(grid, max_lane=max_lane)
    assert np.allclose(half.to_numpy(), np.fft.rfft(x))
    assert np.allclose(signals.irfft(half, max_lane=max_lane).to_numpy(), x)
    z = Grid.from_numpy(spark, half.to_numpy() + 1j, "complex128")
    assert np.allclose(signals.irfft(z, max_lane=max_lane).to_numpy(), np.fft.irfft(half.to_numpy() + 1j, n))


def test_real_transform_of_odd_length(spark):
    x = RNG.normal(size=(2, 15))
    assert np.allclose(signals.rfft(Grid.from_numpy(spark, x, "float64")).to_numpy(), np.fft.rfft(x))


@pytest.mark.parametrize("shape", [(8,), (3, 16), (2, 2, 32)])
def test_antiperiodic_transforms(spark, shape):
    x = RNG.normal(size=shape)
    want = np.fft.fft(np.concatenate([x, -x], axis=-1), axis=-1)[..., 1 : shape[-1] : 2]
    there = signals.aprfft(Grid.from_numpy(spark, x, "float64"))
    assert np.allclose(there.to_numpy(), want)
    assert np.allclose(signals.iaprfft(there).to_numpy(), x)
    assert np.allclose(signals.iaprfft(Grid.from_numpy(spark, want, "complex128"), max_lane=16).to_numpy(), x)


@pytest.mark.parametrize("shapes", [((9, 5), (5, 11)), ((4, 9), (9, 3)), ((3, 5, 6), (3, 6, 7)), ((5, 6), (2, 6, 3))])
def test_tiles(spark, shapes):
    a, b = (RNG.integers(-9, 9, s) for s in shapes)
    ga, gb = Grid.from_numpy(spark, a, "int64"), Grid.from_numpy(spark, b, "int64")
    assert np.array_equal(MatrixMul(ga, gb, tile=4, tile_from=1).call(matrix_a=ga, matrix_b=gb).to_numpy(), a @ b)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200, 4097])
@pytest.mark.parametrize("exclusive", [False, True])
def test_generic_prefixes(spark, n, exclusive):
    """Composition of affine maps, which does not commute."""
    dtype = "struct<a:bigint,b:bigint>"
    p = F.lit(10_007).cast("bigint")
    monoid = Monoid(lambda x, y: F.struct(F.pmod(x["a"] * y["a"], p).alias("a"), F.pmod(x["b"] * y["a"] + y["b"], p).alias("b")), {"a": 1, "b": 0}, dtype)
    grid = Grid(spark.range(n).select(F.col("id").alias("i0"), F.struct((F.col("id") % 7 + 1).alias("a"), (F.col("id") % 5).alias("b")).alias("v")), ArrayMeta((n,), dtype))
    got = [(r["v"]["a"], r["v"]["b"]) for r in Scan(grid, monoid, exclusive=exclusive).call(input=grid).df.orderBy("i0").collect()]
    want, state = [], (1, 0)
    for k in range(n):
        after = state[0] * (k % 7 + 1) % 10_007, (state[1] * (k % 7 + 1) + k % 5) % 10_007
        want.append(state if exclusive else after)
        state = after
    assert got == want


@pytest.mark.parametrize("limit", [kernel.MAX_CONSTANT, 0])
def test_constants_are_broadcast_up_to_a_size(spark, monkeypatch, limit):
    monkeypatch.setattr(kernel, "MAX_CONSTANT", limit)
    x, c = np.arange(30), np.arange(30)[::-1].copy()

    def code(k):
        k.output.store_same(k.input.load_same() + k.table.load_idx(k.idxs[0]))

    op = PureParallel([array("output", (30,), "int64", "o"), array("input", (30,), "int64"), array("table", (30,), "int64", constant=True)], code)
    out = op.call(input=Grid.from_numpy(spark, x, "int64"), table=Grid.from_numpy(spark, c, "int64"))
    assert np.array_equal(out.to_numpy(), x + c)


@pytest.mark.parametrize("bijection", [Bijection(), Bijection("threefry", 32, 2), Bijection("philox", 32, 4)])
@pytest.mark.parametrize("name", ["uniform_float", "normal_bm"])
@pytest.mark.parametrize("n_draws", [1, 3, 8, 21, 50])
def test_counters_by_arithmetic(bijection, name, n_draws):
    sampler = SAMPLERS[name]("float64")
    start = np.array([[0] * (bijection.words - 1) + [(1 << bijection.bitness) - 2], [0] * bijection.words], dtype=bijection.kind)
    drawn, skipped = (State(bijection, seed_key(bijection, 3), np.arange(2), start) for _ in range(2))
    for _ in draws(drawn, sampler, n_draws):
        pass
    skipped.skip(counter_steps(bijection, sampler, n_draws))
    assert np.array_equal(drawn.next_counters(), skipped.counters)


@pytest.mark.parametrize("kind", [("philox", 64, 4), ("philox", 64, 2), ("philox", 32, 2), ("threefry", 32, 4), ("threefry", 64, 2)])
def test_key_generators(kind):
    bijection = Bijection(*kind)
    whole = KeyGenerator.create(bijection, 5, reserve_id_space=False)
    assert whole.base[-1] != 0 and (whole.key(0) == np.array(whole.base, bijection.kind)).all()
    assert int(whole.key(3)[-1]) == (whole.base[-1] + 3) % (1 << bijection.bitness)
    if kind == ("philox", 32, 2):
        with pytest.raises(ValueError):
            KeyGenerator.create(bijection, 5)
        return
    part = KeyGenerator.create(bijection, 5)
    assert part.base[-1] % (1 << 32) == 0 and len({tuple(k) for k in part.keys(np.arange(50))}) == 50
    halves = np.random.default_rng(5).integers(0, 1 << 16, 2)
    assert (part.base[0] >> (bijection.bitness - 32)) == (int(halves[0]) << 16 | int(halves[1]))


def test_numbers_without_reserved_space(spark):
    meta = ArrayMeta((2, 10), "float64")
    ops = [CBRNG(meta, 1, SAMPLERS["uniform_float"]("float64"), seed=1, reserve_id_space=r) for r in (True, False)]
    one, two = (op.bind(counters=op.create_counters(spark))["randoms"].to_numpy() for op in ops)
    assert one.shape == two.shape and not np.allclose(one, two)
