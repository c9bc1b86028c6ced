"""Dense arrays in chunks: one row a block of the array, its values packed in a list.

A ``Grid`` has a row for each element, with its coordinates; here a block of elements shares
one row (``c0, c1, ...`` count blocks along the axes, ``v`` holds the values in row-major
order), so what is moved and stored is little more than the values. Blocks at the end of
an axis are cut short. Rearrangements move blocks and permute inside of them; folds,
transforms and products work on blocks as numpy arrays. Both forms lead to each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid, coords
from .meta import ArrayMeta, is_complex, normalize_axes, real_of, spark_type

#: Values of a block that a rearrangement for lanes aims at (8 MB of doubles).
BLOCK_VALUES = 1 << 20


def div(c: Column, n: int) -> Column:
    return F.call_function("div", c, F.lit(n).cast("bigint"))


def blocks_of(column: pa.Array, dtype: str) -> list[np.ndarray]:
    """The values of each row's list."""
    flat, offsets = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
    if is_complex(dtype):
        kind = np.dtype(dtype)
        values = (flat.field("re").to_numpy(zero_copy_only=False) + 1j * flat.field("im").to_numpy(zero_copy_only=False)).astype(kind)
    else:
        values = flat.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def lists_of(blocks: list[np.ndarray], dtype: str) -> pa.ListArray:
    """A row's list of values for each block."""
    flat = np.concatenate([b.ravel() for b in blocks]) if blocks else np.zeros(0)
    offsets = pa.array(np.cumsum([0, *(b.size for b in blocks)]), pa.int32())
    if is_complex(dtype):
        part = np.dtype(real_of(dtype))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat.real, part)), pa.array(np.ascontiguousarray(flat.imag, part))], names=["re", "im"]))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype("int64" if dtype == "uint32" else dtype)))


def emitted(rows: Iterator[tuple[tuple[int, ...], np.ndarray]], names: list[str], dtype: str) -> Iterator[pa.RecordBatch]:
    """Batches of (numbers, block) rows, of ``BLOCK_VALUES`` values or a little more each."""
    numbers, held, size = [], [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*numbers)]
        return pa.RecordBatch.from_arrays([*columns, lists_of(held, dtype)], names=[*names, "v"])

    for row, block in rows:
        numbers.append(row)
        held.append(block)
        size += block.size
        if size >= BLOCK_VALUES:
            yield batch()
            numbers, held, size = [], [], 0
    if held:
        yield batch()


class Chunks:
    """A DataFrame of blocks with the array's description and the shape of a block."""

    def __init__(self, df: DataFrame, meta: ArrayMeta, chunk: tuple[int, ...]):
        if len(chunk) != meta.ndim or any(c < 1 for c in chunk):
            raise ValueError(f"{chunk} does not cut {meta.shape}")
        self.names = [f"c{k}" for k in range(meta.ndim)]
        self.df, self.meta, self.chunk = df.select(*self.names, "v"), meta, tuple(min(c, max(n, 1)) for c, n in zip(chunk, meta.shape))

    @property
    def counts(self) -> tuple[int, ...]:
        """Blocks along each axis."""
        return tuple(-(-n // c) for n, c in zip(self.meta.shape, self.chunk))

    def sizes(self) -> list[Column]:
        """The shape of a row's block."""
        return [F.least(F.lit(c).cast("bigint"), F.lit(n).cast("bigint") - F.col(name) * c) for name, c, n in zip(self.names, self.chunk, self.meta.shape)]

    @property
    def shape_of(self) -> Callable[[tuple[int, ...]], tuple[int, ...]]:
        """The shape of the block at a place."""
        chunk, shape = self.chunk, self.meta.shape
        return lambda at: tuple(min(c, n - k * c) for k, c, n in zip(at, chunk, shape))

    @staticmethod
    def from_grid(grid: Grid, chunk: tuple[int, ...]) -> Chunks:
        """Elements gathered to blocks; one shuffle."""
        out = Chunks(grid.df.select(*[F.lit(0).alias(f"c{k}") for k in range(grid.meta.ndim)], "v"), grid.meta, chunk)
        place = F.lit(0).cast("bigint")
        for k, c in enumerate(out.chunk):
            place = place * c + F.pmod(F.col(f"i{k}"), F.lit(c).cast("bigint"))
        cells = F.array_sort(F.collect_list(F.struct(place.alias("p"), "v")))
        df = grid.df.groupBy(*[div(F.col(f"i{k}"), c).alias(f"c{k}") for k, c in enumerate(out.chunk)]).agg(F.transform(cells, lambda x: x["v"]).alias("v"))
        return Chunks(df, grid.meta, chunk)

    @staticmethod
    def from_lanes(df: DataFrame, index: list[Column | str], lane: Column | str, shape: tuple[int, ...], dtype: str) -> Chunks:
        """Rows that hold whole lanes along the last axis as lists already: a projection."""
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        own = [as_column(c).cast("bigint").alias(f"c{k}") for k, c in enumerate(index)]
        lane = F.transform(as_column(lane), lambda x: x.cast(spark_type(dtype)))
        return Chunks(df.select(*own, F.lit(0).cast("bigint").alias(f"c{len(index)}"), lane.alias("v")), ArrayMeta(tuple(shape), dtype), (*(1,) * len(index), shape[-1]))

    def to_grid(self) -> Grid:
        """An element a row: a projection."""
        sizes, rest = self.sizes(), F.col("__p").cast("bigint")
        cells = self.df.select(*self.names, *[s.alias(f"__s{k}") for k, s in enumerate(sizes)], F.posexplode("v").alias("__p", "v"))
        index: list[Column] = []
        for k in range(self.meta.ndim - 1, -1, -1):
            own = F.col(f"c{k}") * self.chunk[k]
            if self.chunk[k] > 1:
                own = own + (F.pmod(rest, F.col(f"__s{k}")) if k else rest)
                rest = F.call_function("div", rest, F.col(f"__s{k}")) if k else rest
            index.insert(0, own)
        return Grid(cells.select(*[c.alias(f"i{k}") for k, c in enumerate(index)], "v"), self.meta)

    def map_blocks(self, function: Callable[[tuple[int, ...], np.ndarray], Iterator[tuple[tuple[int, ...], np.ndarray]]], names: list[str], dtype: str) -> DataFrame:
        """Rows (names, v) that ``function(block's place, block)`` gives; nothing is moved."""
        own, shape_of, kind = self.names, self.shape_of, self.meta.dtype

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    for *at, block in zip(*(batch.column(c).to_pylist() for c in own), blocks_of(batch.column("v"), kind)):
                        yield from function(tuple(at), block.reshape(shape_of(tuple(at))))

            yield from emitted(rows(), names, dtype)

        return self.df.mapInArrow(run, ", ".join([*(f"{n} bigint" for n in names), f"v array<{spark_type(dtype)}>"]))

    def transpose(self, axes: tuple[int, ...] | None = None) -> Chunks:
        """Blocks under other places, permuted inside; blocks of one long axis only change their place."""
        order = tuple(reversed(range(self.meta.ndim))) if axes is None else normalize_axes(self.meta.ndim, tuple(axes))
        if len(order) != self.meta.ndim:
            raise ValueError("axes must name every axis once")
        meta, chunk = ArrayMeta(tuple(self.meta.shape[a] for a in order), self.meta.dtype), tuple(self.chunk[a] for a in order)
        if sum(c > 1 for c in self.chunk) <= 1:
            return Chunks(self.df.select(*[F.col(f"c{a}").alias(f"__{k}") for k, a in enumerate(order)], "v").select(*[F.col(f"__{k}").alias(f"c{k}") for k in range(len(order))], "v"), meta, chunk)
        return Chunks(self.map_blocks(lambda at, block: iter([(tuple(at[a] for a in order), block.transpose(order))]), self.names, meta.dtype), meta, chunk)

    def reduce(self, monoid, axes=None) -> Grid:
        """Fold over axes, which stay with size 1: inside of blocks first, then what is left of them by partial aggregation."""
        from .operators.fold import Reduce, is_plain

        axes = normalize_axes(self.meta.ndim, axes)
        if not is_plain(monoid) or not monoid.native or spark_type(monoid.dtype) != spark_type(self.meta.dtype):
            grid = self.to_grid()
            return Reduce(grid, monoid, axes).call(input=grid)
        operation = getattr(np, monoid.accumulate)

        def folded(at, block):
            yield at, operation.reduce(block, axis=axes, keepdims=True, dtype=block.dtype if monoid.accumulate != "add" or block.dtype.kind not in "iu" else np.int64)

        wide = "int64" if monoid.accumulate == "add" and self.meta.dtype.startswith(("int", "uint")) else self.meta.dtype
        left = Chunks(self.map_blocks(folded, self.names, wide), ArrayMeta(tuple(c if k in axes else n for k, (n, c) in enumerate(zip(self.meta.shape, self.counts))), wide), tuple(1 if k in axes else c for k, c in enumerate(self.chunk)))
        grid = left.to_grid()
        rest = [c for k, c in enumerate(coords(self.meta.ndim)) if k not in axes]
        out = grid.df.groupBy(*rest).agg(monoid.native(F.col("v"), lambda c: c).alias("v"))
        index = [F.lit(0).cast("bigint").alias(f"i{k}") if k in axes else F.col(f"i{k}") for k in range(self.meta.ndim)]
        return Grid(out.select(*index, F.col("v").cast(spark_type(self.meta.dtype)).alias("v")), ArrayMeta(tuple(1 if k in axes else n for k, n in enumerate(self.meta.shape)), self.meta.dtype))

    def pieces(self, chunk: tuple[int, ...]) -> DataFrame:
        """(c.., o.., s.., v): parts of blocks by the block of ``chunk`` that they fall in, their offset there and shape."""
        own, nd = self.chunk, self.meta.ndim
        names = [f"{p}{k}" for p in "cos" for k in range(nd)]

        def cut(at, block):
            spans = []
            for k in range(nd):
                first, end = at[k] * own[k], at[k] * own[k] + block.shape[k]
                inner = []
                while first < end:
                    stop = min(end, (first // chunk[k] + 1) * chunk[k])
                    inner.append((first // chunk[k], first % chunk[k], first - at[k] * own[k], stop - first))
                    first = stop
                spans.append(inner)
            for which in np.ndindex(*map(len, spans)):
                parts = [s[j] for s, j in zip(spans, which)]
                yield (*(p[0] for p in parts), *(p[1] for p in parts), *(p[3] for p in parts)), block[tuple(slice(p[2], p[2] + p[3]) for p in parts)]

        return self.map_blocks(cut, names, self.meta.dtype)

    def rechunk(self, chunk: tuple[int, ...]) -> Chunks:
        """The same array in other blocks; its values move once, packed."""
        out = Chunks(self.df, self.meta, chunk)
        if out.chunk == self.chunk:
            return self
        nd, kind, shape_of, names = self.meta.ndim, self.meta.dtype, out.shape_of, self.names
        inner = [f"{p}{k}" for p in "os" for k in range(nd)]
        # sorted by block, so a task holds one block at a time
        dealt = self.pieces(out.chunk).repartition(*names).sortWithinPartitions(*names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                last, block = None, None
                for batch in batches:
                    for row, values in zip(zip(*(batch.column(c).to_pylist() for c in (*names, *inner))), blocks_of(batch.column("v"), kind)):
                        at, offset, size = row[:nd], row[nd : 2 * nd], row[2 * nd :]
                        if at != last:
                            if block is not None:
                                yield last, block
                            last, block = at, np.empty(shape_of(at), values.dtype)
                        block[tuple(slice(o, o + s) for o, s in zip(offset, size))] = values.reshape(size)
                if block is not None:
                    yield last, block

            yield from emitted(rows(), names, kind)

        return Chunks(dealt.mapInArrow(run, ", ".join([*(f"{n} bigint" for n in names), f"v array<{spark_type(kind)}>"])), self.meta, out.chunk)

    def fft(self, axis: int = -1, inverse: bool = False, most: int | None = None) -> Chunks:
        """Transform along an axis: in the blocks where they hold whole lanes, else after one move; lanes over ``most`` as elements."""
        from .operators.spectral import FFT, MAX_LANE

        (axis,) = normalize_axes(self.meta.ndim, axis)
        n, most = self.meta.shape[axis], most or MAX_LANE
        if not is_complex(self.meta.dtype):
            raise ValueError("FFT computation requires array of a complex dtype")
        if n > most:
            grid = self.to_grid()
            return Chunks.from_grid(FFT(grid, axes=(axis,), max_lane=most).call(input=grid, inverse=int(inverse)), self.chunk)
        if self.chunk[axis] < n:
            room, chunk = max(1, BLOCK_VALUES // n), [1] * self.meta.ndim
            for k in sorted((k for k in range(self.meta.ndim) if k != axis), reverse=True):
                chunk[k] = max(1, min(self.chunk[k], room))
                room //= chunk[k]
            chunk[axis] = n
            return self.rechunk(tuple(chunk)).fft(axis, inverse, most)
        transform = np.fft.ifft if inverse else np.fft.fft
        return Chunks(self.map_blocks(lambda at, block: iter([(at, transform(block, axis=axis))]), self.names, self.meta.dtype), self.meta, self.chunk)

    def matmul(self, other: Chunks, tile: int | None = None) -> Chunks:
        """Product of two matrices, by tiles that are summed in place."""
        from .operators.linear import TILE, multiplied, result_dtype

        if self.meta.ndim != 2 or other.meta.ndim != 2 or self.meta.shape[1] != other.meta.shape[0]:
            raise ValueError(f"cannot multiply {self.meta.shape} by {other.meta.shape}")
        tile, dtype = tile or TILE, result_dtype(self.meta.dtype, other.meta.dtype)
        sides = []
        for side in (self, other):
            batch = [F.lit(0).cast("bigint").alias(n) for n in ("c0", "o0")] + [F.lit(1).cast("bigint").alias("s0")]
            sides.append(side.pieces((tile, tile)).select(*batch, *[F.col(f"{p}{k}").alias(f"{p}{k + 1}") for p in "cos" for k in (0, 1)], "v"))
        shape = (1, self.meta.shape[0], self.meta.shape[1], other.meta.shape[1])
        df = multiplied(*sides, shape, (self.meta.dtype, other.meta.dtype), (1, 1), tile, dtype)
        return Chunks(df.select(F.col("bi").alias("c0"), F.col("bj").alias("c1"), "v"), ArrayMeta((shape[1], shape[3]), dtype), (tile, tile))
