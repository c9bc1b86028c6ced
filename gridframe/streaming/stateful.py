"""Streams that need what came before: overlapping frames of a signal, and random draws.

Both keep keyed state in the query's checkpoint, so a restart goes on where the last
committed micro-batch ended, and a batch that is run again gives the same rows. Results do
not depend on how the stream is cut into micro-batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..random.generators import Bijection, Sampler, State, seed_key


def frame_stream(stream: DataFrame, size: int, overlap: int, key: str = "channel", at: str = "i0", value: str = "v") -> DataFrame:
    """(channel, frame, samples): the overlapping frames of each channel's signal, as soon as all their samples are there.

    State is what later frames need: the overlap, and samples that came before their
    predecessors. Frames leave in order, so a sample that never comes holds its channel.
    """
    step = size - overlap
    if not 0 <= overlap < size:
        raise ValueError("frames have to move on")

    def run(channel: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, places, values = state.get if state.exists else (0, [], [])
        part = pd.concat(list(parts))
        places = np.concatenate((np.asarray(places, np.int64), part["i0"].to_numpy(np.int64)))
        values = np.concatenate((np.asarray(values, np.float64), part["v"].to_numpy(np.float64)))
        order = np.argsort(places, kind="stable")
        places, values = places[order], values[order]
        keep = places >= frame * step
        places, values = places[keep], values[keep]
        # samples that follow the frame's first without a gap
        there = int((places == frame * step + np.arange(len(places))).cumprod().sum())
        out = []
        while there >= size:
            out.append((channel[0], frame, values[:size].tolist()))
            frame, places, values, there = frame + 1, places[step:], values[step:], there - step
        state.update((frame, places.tolist(), values.tolist()))
        yield pd.DataFrame(out, columns=["channel", "frame", "samples"])

    rows = stream.select(F.col(key).cast("long").alias("channel"), F.col(at).cast("long").alias("i0"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("channel").applyInPandasWithState(run, "channel long, frame long, samples array<double>", "frame long, places array<long>, samples array<double>", "append", GroupStateTimeout.NoTimeout)


def spectrogram_stream(stream: DataFrame, size: int = 256, overlap: int = 128, pad_to: int | None = None, key: str = "channel", at: str = "i0", value: str = "v") -> DataFrame:
    """(channel, i0 frequency, i1 frame, v): the rows of ``recipes.signals.spectrogram`` of each channel, frame by frame."""
    width = pad_to or size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = 0.5 * (1 - np.cos(np.arange(size) * (2 * math.pi / (size - 1))))
        for batch in batches:
            n = batch.num_rows
            if n:
                samples = batch.column("samples").flatten().to_numpy().reshape(n, size)
                out = np.abs(np.fft.rfft(samples * window, width, axis=1))
                count = out.shape[1]
                yield pa.RecordBatch.from_pydict({"channel": np.repeat(batch.column("channel").to_numpy(), count), "i0": np.tile(np.arange(count), n), "i1": np.repeat(batch.column("frame").to_numpy(), count), "v": out.ravel()})

    return frame_stream(stream, size, overlap, key, at, value).mapInArrow(run, "channel long, i0 long, i1 long, v double")


def draw_stream(stream: DataFrame, sampler: Sampler, seed: int, bijection: Bijection | None = None, generator: str = "generator", at: str = "i0") -> DataFrame:
    """(generator, i0, v): the next draw of its generator for each row, rows of a micro-batch in the order of ``i0``.

    A generator's state is its counter, the parts of its current words that are used, and
    values of the last call that are left.
    """
    bijection = bijection or Bijection("philox", 64, 4)
    base = seed_key(bijection, seed).tolist()
    kind = {"int32": "int", "float32": "float"}.get(sampler.dtype, "long" if sampler.dtype.startswith(("int", "uint")) else "double")
    if sampler.dtype.startswith("complex"):
        raise ValueError("draws of streams are real numbers")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counter, used, drawn, left = state.get if state.exists else (["0"] * bijection.words, -1, False, [])
        own = State(bijection, np.array(base, bijection.kind), np.array([key[0]]), np.array([[int(c) for c in counter]], bijection.kind))
        if drawn:  # the words of the current counter again, as far as they were used
            own._refill(np.arange(1))
            own.used[:] = used
        rows = pd.concat(list(parts)).sort_values("i0", kind="stable")
        values = list(left)
        while len(values) < len(rows):
            values += sampler.draw(own, np.arange(1))[0].tolist()
        now, left = values[: len(rows)], values[len(rows) :]
        state.update(([str(int(c)) for c in own.counters[0]], int(own.used[0]), bool(own.drawn[0]), [float(x) for x in left]))
        yield pd.DataFrame({"generator": key[0], "i0": rows["i0"].to_numpy(), "v": now})

    rows = stream.select(F.col(generator).cast("long").alias("generator"), F.col(at).cast("long").alias("i0"))
    return rows.groupBy("generator").applyInPandasWithState(run, f"generator long, i0 long, v {kind}", "counter array<string>, used int, drawn boolean, spare array<double>", "append", GroupStateTimeout.NoTimeout)
