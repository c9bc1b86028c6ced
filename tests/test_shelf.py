"""Results kept for several consumers of a plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.grid import Grid
from gridframe.meta import ArrayMeta
from gridframe.operators.fold import Scan, sum_of
from gridframe.plans.shelf import Shelf, shared, shared_folder
from gridframe.random.cbrng import CBRNG
from gridframe.random.generators import Bijection, State, draws, gamma, seed_key, vonmises


def tables(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/gridframe")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()


@pytest.mark.parametrize("sampler", [gamma("float64", 0.6, 2.0), vonmises("float64", 1.0, 0.7)], ids=["gamma", "vonmises"])
@pytest.mark.parametrize("bijection", [Bijection("philox", 64, 4), Bijection("threefry", 32, 4)], ids=["philox", "threefry"])
@pytest.mark.parametrize("start", [0, (1 << 64) - 2])
def test_one_pass(spark, sampler, bijection, start):
    """Draws, the counters after them and draws from these, as generators side by side give them."""
    n, start = 50, start % (1 << bijection.bitness)
    op = CBRNG(ArrayMeta((3, n), "float64"), 1, sampler, seed=5, bijection=bijection)
    at = np.array([[1] * (bijection.words - 1) + [start]] * n, dtype=np.uint64)
    state = State(bijection, seed_key(bijection, 5), np.arange(n), at)
    zero = op.create_counters(spark)
    own = F.struct(F.array(*[F.lit(int(x)).cast("decimal(20,0)") if int(x) < 1 << 63 else F.lit(str(int(x))).cast("decimal(20,0)") for x in at[0]]).alias("v"))
    given = Grid(zero.df.withColumn("v", own), zero.meta)
    before = tables(spark)
    with Shelf(spark):
        for _ in range(2):
            out = op.bind(counters=given)
            want = np.array([v for _, v in draws(state, sampler, 3)])
            assert np.array_equal(out["randoms"].to_numpy(), want)
            words = state.next_counters()
            got = {r["i0"]: [int(x) for x in r["v"]["v"]] for r in out["counters"].df.collect()}
            assert got == {i: [int(x) for x in w] for i, w in enumerate(words)}
            for part in out.values():  # both are read from the table of one pass
                plan = part.df._jdf.queryExecution().executedPlan().toString()
                assert "MapInArrow" not in plan and "FileScan" in plan
            given = out["counters"]
        assert len(tables(spark) - before) == 2
    assert tables(spark) == before
    lone = op.bind(counters=zero)  # without a shelf the outputs are lazy
    assert lone["randoms"].df.count() == 3 * n and lone["counters"].df.count() == n and tables(spark) == before


def test_scan_reads_its_input_once(spark):
    values = np.random.default_rng(1).integers(-50, 50, 3000)
    grid = Grid.from_numpy(spark, values)
    before = tables(spark)
    with Shelf(spark):
        out = Scan(grid, sum_of("int64"), block=64).call(input=grid)
        assert tables(spark) - before
        assert np.array_equal(out.to_numpy(), np.cumsum(values))
    assert tables(spark) == before


def test_ownership(spark):
    """Inner shelves take what is made inside of them; a failed plan leaves nothing behind."""
    df, before = spark.range(5), tables(spark)
    assert shared(df) is df
    with Shelf(spark) as outer:
        kept = outer.keep(df)
        with Shelf(spark) as inner:
            assert shared(df) is not df and len(inner._paths) == len(outer._paths) == 1
        assert kept.count() == 5 and len(tables(spark) - before) == 1
        with pytest.raises(ValueError, match="not open"):
            inner.keep(df)
    with pytest.raises(RuntimeError), Shelf(spark) as lost:
        lost.keep(df)
        raise RuntimeError
    assert tables(spark) == before
