"""Elementwise operators on streams of array elements.

Transformations and coordinate maps are projections, so they run on a streaming
DataFrame as they are; explicit counters make random numbers a pure function of the
generator, so they do as well. Folds need the whole array and stay with batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..grid import Grid
from ..meta import ArrayMeta
from ..plans.computation import Computation


def apply_to_stream(stream: DataFrame, meta: ArrayMeta, computation: Computation, parameter: str, **scalars: object) -> DataFrame:
    """Output rows of a projection-only computation for rows of one array parameter."""
    (out,) = computation.bind(**{parameter: Grid(stream, meta)}, **scalars).values()
    return out.df


def each_batch(computation: Callable[[Grid], Grid], meta: ArrayMeta, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a whole array in each micro-batch, any computation on it."""

    def run(df: DataFrame, epoch: int) -> None:
        sink(computation(Grid(df, meta)).df, epoch)

    return run
