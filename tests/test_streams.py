"""Stateful streams: the batch results, over any cut into micro-batches and over restarts."""

import numpy as np
import pytest

from gridframe.grid import Grid
from gridframe.meta import ArrayMeta
from gridframe.random.cbrng import CBRNG
from gridframe.random.generators import SAMPLERS
from gridframe.recipes.signals import spectrogram
from gridframe.streaming.stateful import draw_stream, frame_stream, spectrogram_stream


@pytest.fixture
def streamed(spark, tmp_path):
    """Rows of a streaming plan over batches of rows; the query is stopped and started again after each of them."""

    def run(batches, schema, plan):
        source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            plan(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(sink)

    return run


def test_frames_and_spectrogram_over_restarts(spark, streamed):
    rng = np.random.default_rng(1)
    signals = rng.normal(size=(2, 150))
    rows = [(c, k, float(signals[c, k])) for c in range(2) for k in range(150)]
    rows = [rows[k] for k in np.argsort([r[1] + rng.integers(0, 9) for r in rows], kind="stable")]  # a little out of order
    got = streamed([rows[:70], rows[70:190], rows[190:]], "channel long, i0 long, v double", lambda s: spectrogram_stream(s, 32, 12, 64)).collect()
    for c in range(2):
        grid = Grid.from_numpy(spark, signals[c], "float64")
        want = spectrogram(grid, 32, 12, 64).to_numpy()
        mine = np.full(want.shape, np.nan)
        for r in got:
            if r["channel"] == c:
                assert np.isnan(mine[r["i0"], r["i1"]])  # each once
                mine[r["i0"], r["i1"]] = r["v"]
        assert np.allclose(mine, want)


def test_state_is_the_overlap(spark):
    with pytest.raises(ValueError):
        frame_stream(spark.readStream.format("rate").load(), 8, 8)


@pytest.mark.parametrize("name, dtype, options", [("uniform_integer", "int32", {"low": -10, "high": 98}), ("normal_bm", "float64", {}), ("gamma", "float64", {"shape": 3.0})])
def test_draws_over_restarts(spark, streamed, name, dtype, options):
    """The draws of a batch, whatever rows a micro-batch has."""
    n, generators = 9, 3
    sampler = SAMPLERS[name](dtype, **options)
    op = CBRNG(ArrayMeta((n, generators), dtype), 1, sampler, seed=5)
    want = op.bind(counters=op.create_counters(spark))["randoms"].to_numpy()
    rows = [(g, k) for k in range(n) for g in range(generators)]
    got = streamed([rows[:4], rows[4:17], rows[17:]], "generator long, i0 long", lambda s: draw_stream(s, sampler, 5)).collect()
    assert len(got) == n * generators
    for r in got:
        assert r["v"] == want[r["i0"], r["generator"]]
