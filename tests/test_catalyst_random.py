"""Threefry as column expressions: the numbers of numpy, without Python in the plan."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.grid import Grid
from gridframe.meta import ArrayMeta
from gridframe.random import cbrng
from gridframe.random.cbrng import CBRNG
from gridframe.random.generators import SAMPLERS, Bijection

KINDS = [Bijection("threefry", b, w) for b in (32, 64) for w in (2, 4)]


def both(spark, monkeypatch, bijection, sampler, draws, start=None):
    """(randoms, counters) by expressions and by numpy."""
    meta, out = ArrayMeta((draws, 5), sampler.dtype), []
    for most in (4096, 0):
        monkeypatch.setattr(cbrng, "MAX_DRAWS", most)
        op = CBRNG(meta, 1, sampler, seed=7, bijection=bijection)
        counters = op.create_counters(spark)
        if start is not None:
            words = F.array(*[F.lit(Decimal(x)).cast("decimal(20,0)") for x in start])
            counters = Grid(counters.df.select("i0", F.struct(words.alias("v")).alias("v")), counters.meta)
        found = op.bind(counters=counters)
        out.append((found["randoms"], found["counters"].df.orderBy("i0").collect()))
    (one, c1), (two, c2) = out
    plan = lambda grid: grid.df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan(one) and "MapInArrow" in plan(two)
    assert np.array_equal(one.to_numpy(), two.to_numpy()) and c1 == c2


@pytest.mark.parametrize("bijection", KINDS)
def test_same_numbers(spark, monkeypatch, bijection):
    for sampler, draws in ((SAMPLERS["uniform_integer"]("int32", -10, 98), 7), (SAMPLERS["uniform_float"]("float64", -5.0, 7.7), 6), (SAMPLERS["uniform_float"]("float32"), 5)):
        both(spark, monkeypatch, bijection, sampler, draws)


@pytest.mark.parametrize("bijection", [KINDS[1], KINDS[2]])
def test_counters_carry(spark, monkeypatch, bijection):
    full = (1 << bijection.bitness) - 1
    both(spark, monkeypatch, bijection, SAMPLERS["uniform_float"]("float64"), 9, start=[0] * (bijection.words - 2) + [full, full - 1])
    both(spark, monkeypatch, bijection, SAMPLERS["uniform_float"]("float64"), 9, start=[full] * bijection.words)


def test_many_refusals_are_drawn_in_numpy(spark):
    sampler = SAMPLERS["uniform_integer"]("uint32", 0, (1 << 31) + 1)
    op = CBRNG(ArrayMeta((3, 4), "uint32"), 1, sampler, seed=1, bijection=Bijection("threefry", 32, 4))
    assert "MapInArrow" in op.bind(counters=op.create_counters(spark))["randoms"].df._jdf.queryExecution().executedPlan().toString()


def test_refused_words_are_passed_over(spark, monkeypatch):
    """A limit that refuses one word in a thousand, with enough kept ready."""
    monkeypatch.setattr(cbrng, "FEW_REFUSED", 1.0)
    n = (1 << 32) // 1000
    sampler = SAMPLERS["uniform_integer"]("uint32", 0, n + 4_300)
    assert 0 < (1 << 32) - sampler.plain[3]
    both(spark, monkeypatch, Bijection("threefry", 32, 4), sampler, 200)
