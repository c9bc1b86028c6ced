"""Elementwise user code recorded as joins and projections.

User code gets a ``Kernel`` and describes one element: it loads values at its own or
at computed indices and stores values the same way. Loads at the element's own index
of the guiding array are its value column; other loads become equi-joins on the
computed coordinates; stores become projections, several of them a union. Loads at an affine
index (``load_affine``) are inverted: the array's rows are projected to the elements
that load them, and all such loads and the guiding array meet in one grouping.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, coords
from ..meta import ArrayMeta, Parameter, spark_type


#: Elements of a constant array that is broadcast; a larger one is joined by a shuffle.
MAX_CONSTANT = 1 << 20


@dataclass(frozen=True)
class Affine:
    """An index of an array: along its axis j, ``signs[j]`` times the element's index on axis ``axes[j]`` plus ``offsets[j]``.

    With ``wrap`` indices go around the end, else elements that point outside load nothing.
    """

    axes: tuple[int, ...]
    signs: tuple[int, ...]
    offsets: tuple[int, ...]
    wrap: bool = False

    def check(self, shape: tuple[int, ...], source: tuple[int, ...]) -> None:
        if sorted(self.axes) != list(range(len(shape))) or not len(source) == len(self.axes) == len(self.signs) == len(self.offsets) or any(s not in (1, -1) for s in self.signs):
            raise ValueError("the index cannot be inverted")
        if self.wrap and any(shape[a] != n for a, n in zip(self.axes, source)):
            raise ValueError("an index that goes around needs axes of the same size")

    def inverse(self, shape: tuple[int, ...]) -> list[Column]:
        """The element that loads a row of the array, by the row's coordinates."""
        out: dict[int, Column] = {}
        for j, (axis, sign, offset) in enumerate(zip(self.axes, self.signs, self.offsets)):
            k = F.col(f"i{j}") - offset if sign > 0 else F.lit(offset).cast("bigint") - F.col(f"i{j}")
            out[axis] = F.pmod(k, F.lit(shape[axis]).cast("bigint")) if self.wrap else k
        return [out[axis] for axis in range(len(shape))]


class Accessor:
    """One parameter inside user code."""

    def __init__(self, kernel: Kernel, parameter: Parameter):
        self._kernel, self._parameter = kernel, parameter
        self.dtype, self.shape = parameter.meta.dtype, parameter.meta.shape

    def load_same(self) -> Column:
        return self._kernel._load(self._parameter, self._kernel.idxs)

    def load_idx(self, *index: Column) -> Column:
        return self._kernel._load(self._parameter, list(index))

    def load_affine(self, offsets: tuple[int, ...], signs: tuple[int, ...] | None = None, axes: tuple[int, ...] | None = None, wrap: bool = False) -> Column:
        """The element at ``signs * index + offsets``, axes in the order ``axes``: without a join."""
        n = len(offsets)
        affine = Affine(tuple(axes or range(n)), tuple(signs or (1,) * n), tuple(offsets), wrap)
        return self._kernel._load_affine(self._parameter, affine)

    def load_combined_idx(self, slices: tuple[int, ...], *index: Column) -> Column:
        return self.load_idx(*split(self.shape, slices, index))

    def store_same(self, value: Column, where: Column | None = None) -> None:
        self._kernel._store(self._parameter, self._kernel.idxs, value, where)

    def store_idx(self, *index_and_value: Column, where: Column | None = None) -> None:
        self._kernel._store(self._parameter, list(index_and_value[:-1]), index_and_value[-1], where)

    def store_combined_idx(self, slices: tuple[int, ...], *index_and_value: Column, where: Column | None = None) -> None:
        self.store_idx(*split(self.shape, slices, index_and_value[:-1]), index_and_value[-1], where=where)


def split(shape: tuple[int, ...], slices: tuple[int, ...], index: tuple[Column, ...]) -> list[Column]:
    """Indices of an array from those of one whose axes are combined by ``slices``."""
    out, at = [], 0
    for n, flat in zip(slices, index):
        part = ArrayMeta(shape[at : at + n], "")
        out += [F.pmod(F.call_function("div", flat.cast("bigint"), F.lit(s).cast("bigint")), F.lit(size).cast("bigint")) for size, s in zip(part.shape, part.strides)]
        at += n
    return out


class Kernel:
    """Records what user code loads and stores, then builds the outputs."""

    def __init__(self, spark: SparkSession, shape: tuple[int, ...], parameters: list[Parameter], grids: dict[str, Grid], scalars: dict[str, Column]):
        self._spark, self._shape, self._grids = spark, tuple(shape), grids
        self.idxs = [F.col(f"__k{k}") for k in range(len(shape))]
        self._loads: list[tuple[str, list[Column] | None, str]] = []
        self._affine: list[tuple[str, Affine, str]] = []
        self._stores: dict[str, list[tuple[list[Column], Column, Column | None]]] = {}
        self._constant = {p.name for p in parameters if p.annotation.constant}
        self._same: dict[str, Column] = {}
        self._base: str | None = None
        for p in parameters:
            setattr(self, p.name, Accessor(self, p) if p.annotation.is_array else scalars.get(p.name))

    def _load(self, parameter: Parameter, index: list[Column]) -> Column:
        name = parameter.name
        if name not in self._grids:
            raise ValueError(f"'{name}' cannot be loaded")
        same = index is self.idxs
        if same and name in self._same:
            return self._same[name]
        column = f"__v{len(self._loads)}"
        if same and self._base is None and parameter.meta.shape == self._shape:
            self._base = name
            self._loads.append((name, None, column))
        else:
            index = index[len(index) - parameter.meta.ndim :] if same else index
            self._loads.append((name, index, column))
        if same:
            self._same[name] = F.col(column)
        return F.col(column)

    def _load_affine(self, parameter: Parameter, affine: Affine) -> Column:
        if parameter.name not in self._grids:
            raise ValueError(f"'{parameter.name}' cannot be loaded")
        affine.check(self._shape, parameter.meta.shape)
        column = f"__w{len(self._affine)}"
        self._affine.append((parameter.name, affine, column))
        return F.col(column)

    def _store(self, parameter: Parameter, index: list[Column], value: Column, where: Column | None) -> None:
        self._stores.setdefault(parameter.name, []).append((index, value, where))

    def run(self, code: Callable[[Kernel], None], outputs: dict[str, ArrayMeta]) -> dict[str, Grid]:
        code(self)
        own = [f"__k{k}" for k in range(len(self._shape))]
        base = next((x for x in self._loads if x[1] is None), None)
        if base:
            df = self._grids[base[0]].df.select(*[F.col(c).alias(k) for c, k in zip(coords(len(own)), own)], F.col("v").alias(base[2]))
        else:
            full = Grid.filled(self._spark, self._shape, "int8", F.lit(0)).df
            df = full.select(*[F.col(c).alias(k) for c, k in zip(coords(len(own)), own)])
        if self._affine:
            df = self._met(df, own, base)
        for name, index, column in self._loads:
            if index is not None:
                df = self._joined(df, name, index, column)
        out = {}
        for name, meta in outputs.items():
            parts = [self._projected(df, *store, meta) for store in self._stores.get(name, [])]
            if not parts:
                continue
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            out[name] = Grid(whole, meta)
        return out

    def _met(self, df: DataFrame, own: list[str], base: tuple | None) -> DataFrame:
        """Elements with what they load at affine indices: rows of all arrays by the element they belong to, in one grouping."""
        sides = [(base[2], df, self._grids[base[0]].meta.dtype)] if base else [("__v", df.withColumn("__v", F.lit(True)), "bool")]
        for name, affine, column in self._affine:
            grid = self._grids[name]
            rows = grid.df.select(*[c.alias(k) for c, k in zip(affine.inverse(self._shape), own)], F.col("v").alias(column))
            for k, n in zip(own, self._shape):
                rows = rows.where((F.col(k) >= 0) & (F.col(k) < n))
            sides.append((column, rows, grid.meta.dtype))
        whole = None
        for column, rows, _ in sides:
            part = rows.select(*own, *[F.col(c) if c == column else F.lit(None).cast(spark_type(kind)).alias(c) for c, _, kind in sides])
            whole = part if whole is None else whole.unionByName(part)
        # one row of each side at most: the greatest is the only one; structs have no hash aggregate for it
        value = lambda c, kind: (F.first(c, ignorenulls=True) if spark_type(kind).startswith(("struct", "array")) else F.max(c)).alias(c)
        met = whole.groupBy(*own).agg(*[value(c, kind) for c, _, kind in sides])
        for c, _, _ in sides:
            met = met.where(F.col(c).isNotNull())
        return met if base else met.drop("__v")

    def _joined(self, df: DataFrame, name: str, index: list[Column], column: str) -> DataFrame:
        grid = self._grids[name]
        keys = [f"{column}_{k}" for k in range(grid.meta.ndim)]
        source = grid.df.select(*[F.col(c).alias(k) for c, k in zip(coords(grid.meta.ndim), keys)], F.col("v").alias(column))
        if name in self._constant and grid.meta.size <= MAX_CONSTANT:
            source = F.broadcast(source)
        df = df.withColumns({f"{k}x": i.cast("bigint") for k, i in zip(keys, index)})
        met = [F.col(f"{k}x") == F.col(k) for k in keys]
        return df.join(source, met, "inner").drop(*keys, *[f"{k}x" for k in keys])

    @staticmethod
    def _projected(df: DataFrame, index: list[Column], value: Column, where: Column | None, meta: ArrayMeta) -> DataFrame:
        df = df if where is None else df.where(where)
        index = [F.lit(0)] * (meta.ndim - len(index)) + list(index)
        return df.select(*[c.cast("bigint").alias(f"i{k}") for k, c in enumerate(index)], value.alias("v"))
