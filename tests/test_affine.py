"""Loads at affine indices: one grouping instead of a join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.grid import Grid
from gridframe.meta import array
from gridframe.operators.pure import PureParallel
from gridframe.plans.kernel import Affine

RNG = np.random.default_rng(4)


def run(spark, x, code, shape=None, **more):
    dtype = str(x.dtype)
    shape = shape or x.shape
    given = {"input": x, **more}
    op = PureParallel([array("output", shape, dtype, "o"), *(array(n, v.shape, str(v.dtype)) for n, v in given.items())], code)
    return op.call(**{n: Grid.from_numpy(spark, v) for n, v in given.items()})


def test_mirrors_shifts_and_turns(spark):
    x = RNG.integers(-9, 9, (5, 5))
    assert np.array_equal(run(spark, x, lambda k: k.output.store_same(k.input.load_same() - k.input.load_affine((4, 0), (-1, 1)))).to_numpy(), x - x[::-1])
    assert np.array_equal(run(spark, x, lambda k: k.output.store_same(k.input.load_same() + k.input.load_affine((0, 0), axes=(1, 0)))).to_numpy(), x + x.T)
    assert np.array_equal(run(spark, x, lambda k: k.output.store_same(k.input.load_affine((2, -1), wrap=True))).to_numpy(), np.roll(x, (-2, 1), (0, 1)))


def test_indices_outside_load_nothing(spark):
    x = np.arange(6)
    rows = run(spark, x, lambda k: k.output.store_same(k.input.load_same() * 10 + k.input.load_affine((2,)))).df.collect()
    assert {r["i0"]: r["v"] for r in rows} == {k: 10 * k + k + 2 for k in range(4)}


def test_several_arrays_and_other_loads(spark):
    x, y = RNG.integers(-9, 9, 8), RNG.integers(-9, 9, 12)

    def code(k):
        k.output.store_same(k.input.load_same() + 2 * k.input.load_affine((7,), (-1,)) + 3 * k.other.load_affine((3,)) + 5 * k.other.load_idx(F.call_function("div", k.idxs[0], F.lit(2).cast("bigint"))))

    assert np.array_equal(run(spark, x, code, other=y).to_numpy(), x + 2 * x[::-1] + 3 * y[3:11] + 5 * y[np.arange(8) // 2])


def test_complex_values(spark):
    z = RNG.normal(size=6) + 1j * RNG.normal(size=6)

    def code(k):
        a, b = k.input.load_same(), k.input.load_affine((5,), (-1,))
        k.output.store_same(F.struct((a["re"] + b["re"]).alias("re"), (a["im"] - b["im"]).alias("im")))

    assert np.allclose(run(spark, z, code).to_numpy(), z + np.conj(z[::-1]))


def test_one_exchange_and_no_join(spark):
    out = run(spark, np.arange(50), lambda k: k.output.store_same(k.input.load_same() - k.input.load_affine((49,), (-1,))))
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_indices_that_cannot_be_inverted():
    for affine, shape, source in ((Affine((0, 0), (1, 1), (0, 0)), (3, 3), (3, 3)), (Affine((0,), (2,), (0,)), (3,), (3,)), (Affine((0,), (1,), (0,), True), (3,), (4,)), (Affine((0,), (1,), (0,)), (3, 3), (3,))):
        with pytest.raises(ValueError):
            affine.check(shape, source)
