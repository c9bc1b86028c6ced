"""Rearrangements; all are projections of coordinates, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import coords
from ..meta import array, normalize_axes, scalar
from ..plans.computation import Computation, meta_of


def shifted(index: list[Column], shape: tuple[int, ...], axes, sign: int) -> list[Column]:
    """Indices moved by half their axis (rounded down), forth or back."""
    moved = normalize_axes(len(shape), axes)
    return [F.pmod(c.cast("bigint") + F.lit(sign * (n // 2)), F.lit(n).cast("bigint")) if k in moved else c for k, (c, n) in enumerate(zip(index, shape))]


class Transpose(Computation):
    """Axes in another order; reversed by default."""

    def __init__(self, arr, axes=None):
        self._meta = meta = meta_of(arr)
        self._axes = tuple(reversed(range(meta.ndim))) if axes is None else normalize_axes(meta.ndim, tuple(axes))
        if len(self._axes) != meta.ndim:
            raise ValueError("axes must name every axis once")
        self._shape = tuple(meta.shape[a] for a in self._axes)
        super().__init__([array("output", self._shape, meta.dtype, "o"), array("input", meta.shape, meta.dtype)])

    def _build(self, spark, arrays, scalars):
        return {"output": arrays["input"].with_coords([F.col(f"i{a}") for a in self._axes], self._shape)}


class Roll(Computation):
    """Elements moved along an axis by ``shift``, around the end."""

    def __init__(self, arr, axis=-1):
        self._meta = meta = meta_of(arr)
        (self._axis,) = normalize_axes(meta.ndim, axis)
        super().__init__([array("output", meta.shape, meta.dtype, "o"), array("input", meta.shape, meta.dtype), scalar("shift", "int32")])

    def _rolled(self, grid, shift):
        n = self._meta.shape[self._axis]
        index = [F.col(c) for c in coords(self._meta.ndim)]
        index[self._axis] = F.pmod(index[self._axis] + F.lit(int(shift) % n), F.lit(n).cast("bigint"))
        return grid.with_coords(index, self._meta.shape)

    def _build(self, spark, arrays, scalars):
        return {"output": self._rolled(arrays["input"], scalars["shift"])}


class RollInplace(Roll):
    """Roll of an array that is input and output; the input itself stays as it is."""

    def __init__(self, arr, axis=-1):
        self._meta = meta = meta_of(arr)
        (self._axis,) = normalize_axes(meta.ndim, axis)
        Computation.__init__(self, [array("array", meta.shape, meta.dtype, "io"), scalar("shift", "int32")])

    def _build(self, spark, arrays, scalars):
        return {"array": self._rolled(arrays["array"], scalars["shift"])}


class FFTShift(Computation):
    """Half-axis shift, inverse on demand."""

    def __init__(self, arr, axes=None):
        self._meta = meta = meta_of(arr)
        self._axes = normalize_axes(meta.ndim, axes)
        super().__init__([array("output", meta.shape, meta.dtype, "o"), array("input", meta.shape, meta.dtype), scalar("inverse", "int32", 0)])

    def _build(self, spark, arrays, scalars):
        index = [F.col(c) for c in coords(self._meta.ndim)]
        return {"output": arrays["input"].with_coords(shifted(index, self._meta.shape, self._axes, -1 if scalars["inverse"] else 1), self._meta.shape)}
