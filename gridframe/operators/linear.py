"""Matrix multiplication and entrywise norms.

Products join on the contracted index and aggregate partially. From ``TILE_FROM``
multiplications up, both sides are cut in square tiles and the tiles multiplied in
numpy, which moves each element once for a row of tiles and not for every element. The
tiles of one output tile meet sorted by the contracted index and are summed in place, so a
task holds three tiles, and only sums leave it. Where output tiles are fewer than the
cluster's cores, the contracted index is cut in segments, whose sums are added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import cplx
from ..chunks import Chunks, blocks_of, div, emitted
from ..grid import Grid
from ..meta import COMPLEX_OF, ArrayMeta, array, is_complex, normalize_axes, real_of, spark_type
from ..plans.computation import Computation, meta_of
from .fold import Reduce, sum_of

TILE_FROM = 1 << 22
TILE = 256
#: A side up to this many elements (under 2 MB) is broadcast.
SMALL_SIDE = 1 << 16


def result_dtype(a: str, b: str) -> str:
    """Kind of a product."""
    real = str(np.result_type(real_of(a), real_of(b)))
    return COMPLEX_OF["float64" if real == "float64" else "float32"] if is_complex(a) or is_complex(b) else real


class MatrixMul(Computation):
    """Product over the last two axes; leading axes are batches, piecewise or one for all."""

    def __init__(self, a, b, transposed_a: bool = False, transposed_b: bool = False, tile: int = TILE, tile_from: int = TILE_FROM):
        a, b = meta_of(a), meta_of(b)
        self._a, self._b, self._ta, self._tb, self._tile = a, b, transposed_a, transposed_b, tile
        shape_a = a.shape if a.ndim > 1 else (1, *a.shape)
        shape_b = b.shape if b.ndim > 1 else (*b.shape, 1)
        self._shape_a, self._shape_b = shape_a, shape_b
        m, k = shape_a[-2:][:: -1 if transposed_a else 1]
        k2, n = shape_b[-2:][:: -1 if transposed_b else 1]
        batch_a, batch_b = math.prod(shape_a[:-2]), math.prod(shape_b[:-2])
        if k != k2:
            raise ValueError(f"inner sizes differ: {k} and {k2}")
        if batch_a != batch_b and 1 not in (batch_a, batch_b):
            raise ValueError(f"batch sizes differ: {batch_a} and {batch_b}")
        self._batch_a, self._batch_b, self._k = batch_a, batch_b, k
        lead = shape_a[:-2] if batch_a != 1 else shape_b[:-2]
        width = max(len(shape_a), len(shape_b)) - 2
        self._shape = (*(1,) * (width - len(lead)), *lead, m, n)
        self._dtype = result_dtype(a.dtype, b.dtype)
        self._tiled = max(batch_a, batch_b) * m * k * n >= tile_from and not spark_type(self._dtype).startswith("decimal")
        super().__init__([array("output", self._shape, self._dtype, "o"), array("matrix_a", a.shape, a.dtype), array("matrix_b", b.shape, b.dtype)])

    def _build(self, spark, arrays, scalars):
        m, n = self._shape[-2:]
        batch = max(self._batch_a, self._batch_b)
        a = arrays["matrix_a"].reshape((self._batch_a, *self._shape_a[-2:])).df
        b = arrays["matrix_b"].reshape((self._batch_b, *self._shape_b[-2:])).df
        a = a.select(F.col("i0").alias("ga"), F.col("i2" if self._ta else "i1").alias("i"), F.col("i1" if self._ta else "i2").alias("k"), F.col("v").alias("va"))
        b = b.select(F.col("i0").alias("gb"), F.col("i2" if self._tb else "i1").alias("kb"), F.col("i1" if self._tb else "i2").alias("j"), F.col("v").alias("vb"))
        shared = self._batch_a == self._batch_b
        group = F.col("ga") if self._batch_a != 1 else F.col("gb")
        if self._tiled:
            df = self._tiles(a, b, m, n)
        else:
            met = F.col("k") == F.col("kb")
            met = met & (F.col("ga") == F.col("gb")) if shared else met
            if self._b.size <= min(SMALL_SIDE, self._a.size):
                b = F.broadcast(b)
            elif self._a.size <= SMALL_SIDE:
                a = F.broadcast(a)
            wide = "complex128" if is_complex(self._dtype) else "float64" if self._dtype.startswith("float") else "int64"
            product = cplx.mul(F.col("va"), self._a.dtype, F.col("vb"), self._b.dtype, wide)
            df = a.join(b, met).select(group.alias("g"), "i", "j", product.alias("p")).groupBy("g", "i", "j")
            if is_complex(wide):
                df = df.agg(cplx.make(F.sum("p.re"), F.sum("p.im"), self._dtype).alias("v"))
            else:
                df = df.agg(F.sum("p").cast(spark_type(self._dtype)).alias("v"))
        out = Grid(df.select(F.col("g").alias("i0"), F.col("i").alias("i1"), F.col("j").alias("i2"), "v"), ArrayMeta((batch, m, n), self._dtype))
        return {"output": out.reshape(self._shape)}

    def _tiles(self, a, b, m, n):
        """Elements of the product by tiles."""
        wide = wide_dtype(self._dtype)
        sides = []
        for df, names, batch, shape, dtype in ((a, ("ga", "i", "k", "va"), self._batch_a, (m, self._k), self._a.dtype), (b, ("gb", "kb", "j", "vb"), self._batch_b, (self._k, n), self._b.dtype)):
            v = cplx.cast(F.col(names[3]), dtype, wide)
            grid = Grid(df.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(names[:3])], v.alias("v")), ArrayMeta((batch, *shape), wide))
            cut = Chunks.from_grid(grid, (1, self._tile, self._tile))
            whole = [F.lit(0).cast("bigint").alias(f"o{k}") for k in range(3)] + [s.alias(f"s{k}") for k, s in enumerate(cut.sizes())]
            sides.append(cut.df.select(*cut.names, *whole, "v"))
        batch = max(self._batch_a, self._batch_b)
        df = multiplied(*sides, (batch, m, self._k, n), (wide, wide), (self._batch_a, self._batch_b), self._tile, wide)
        out = Chunks(df.select(F.col("g").alias("c0"), F.col("bi").alias("c1"), F.col("bj").alias("c2"), "v"), ArrayMeta((batch, m, n), wide), (1, self._tile, self._tile)).to_grid()
        return out.df.select(F.col("i0").alias("g"), F.col("i1").alias("i"), F.col("i2").alias("j"), cplx.cast(F.col("v"), wide, self._dtype).alias("v"))


def wide_dtype(dtype: str) -> str:
    """Kind in which products are summed."""
    return "complex128" if is_complex(dtype) else "float64" if dtype.startswith("float") else "int64"


#: Tiles of the contracted index in a segment at least.
SEGMENT_TILES = 4


def multiplied(a: DataFrame, b: DataFrame, shape: tuple[int, int, int, int], dtypes: tuple[str, str], batches: tuple[int, int], tile: int, dtype: str) -> DataFrame:
    """(g, bi, bj, v): tiles of products of pieces (c0..2, o0..2, s0..2, v) of tiles (batch, row, column).

    ``shape`` is (batch, m, k, n). Every piece goes to the output tiles that it is part of;
    there they are sorted by contracted tile and side, and put together as they come.
    """
    count, m, k, n = shape
    n_i, n_k, n_j = (-(-x // tile) for x in (m, k, n))
    cores = a.sparkSession.sparkContext.defaultParallelism
    segments = max(1, min(-(-n_k // SEGMENT_TILES), -(-2 * cores // (count * n_i * n_j))))
    length = -(-n_k // segments)
    wide = wide_dtype(dtype)
    each = lambda size: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")))
    batch = lambda own: F.col("c0") if own == count else each(count)
    place = [F.col(x) for x in ("o1", "o2", "s1", "s2")]
    # a select has one generator at most
    left = a.select("*", batch(batches[0]).alias("g")).select("g", F.col("c1").alias("bi"), each(n_j).alias("bj"), F.col("c2").alias("bk"), F.lit(0).cast("bigint").alias("side"), *place, as_wide("v", dtypes[0], wide))
    right = b.select("*", batch(batches[1]).alias("g")).select("g", each(n_i).alias("bi"), F.col("c2").alias("bj"), F.col("c1").alias("bk"), F.lit(1).cast("bigint").alias("side"), *place, as_wide("v", dtypes[1], wide))
    keys = ["g", "bi", "bj", "segment"]
    dealt = left.unionByName(right).withColumn("segment", div(F.col("bk"), length)).repartition(*keys).sortWithinPartitions(*keys, "bk", "side")
    names = [*keys, "bk", "side", "o1", "o2", "s1", "s2"]
    kind = np.dtype(wide)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last = total = None
            at, sides = None, [None, None]

            def add():
                if sides[0] is not None and sides[1] is not None:
                    np.add(total, sides[0] @ sides[1], out=total)

            for rows_ in batches_:
                for (*key, bk, side, o1, o2, s1, s2), values in zip(zip(*(rows_.column(c).to_pylist() for c in names)), blocks_of(rows_.column("v"), wide)):
                    if (key, bk) != (last, at) and last is not None:
                        add()
                        sides = [None, None]
                        if key != last:
                            yield tuple(last), total
                    if key != last:
                        total = np.zeros((min(tile, m - key[1] * tile), min(tile, n - key[2] * tile)), kind)
                    last, at = key, bk
                    if sides[side] is None:
                        inner = min(tile, k - bk * tile)
                        sides[side] = np.zeros((total.shape[0], inner) if not side else (inner, total.shape[1]), kind)
                    sides[side][o1 : o1 + s1, o2 : o2 + s2] = values.reshape(s1, s2)
            if last is not None:
                add()
                yield tuple(last), total

        yield from emitted(rows(), keys, wide)

    schema = ", ".join([*(f"{c} bigint" for c in keys), f"v array<{spark_type(wide)}>"])
    sums = dealt.mapInArrow(run, schema)
    if segments > 1:
        sums = added(sums.drop("segment"), wide)
    return sums.select("g", "bi", "bj", as_wide("v", wide, dtype))


def as_wide(column: str, dtype: str, wide: str):
    """A list of values in another kind."""
    if spark_type(dtype) == spark_type(wide):
        return F.col(column)
    return F.transform(column, lambda x: cplx.cast(x, dtype, wide)).alias(column)


def added(tiles: DataFrame, dtype: str) -> DataFrame:
    """(g, bi, bj, v): sums of equal tiles, one after the other."""
    keys = ["g", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last = total = None
            for batch in batches:
                for key, values in zip(zip(*(batch.column(c).to_pylist() for c in keys)), blocks_of(batch.column("v"), dtype)):
                    if key == last:
                        total = total + values
                        continue
                    if last is not None:
                        yield last, total
                    last, total = key, values
            if last is not None:
                yield last, total

        yield from emitted(rows(), keys, dtype)

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join([*(f"{c} bigint" for c in keys), f"v array<{spark_type(dtype)}>"]))


class EntrywiseNorm(Computation):
    """(sum |a| ** order) ** (1 / order) over axes, which stay with size 1."""

    def __init__(self, arr, order: float = 2, axes=None):
        self._meta = meta = meta_of(arr)
        self._order, self._axes = order, normalize_axes(meta.ndim, axes)
        dtype = real_of(meta.dtype)
        dtype = dtype if dtype.startswith("float") else "float64"
        shape = tuple(1 if k in self._axes else n for k, n in enumerate(meta.shape))
        self._wide = ArrayMeta(meta.shape, "float64")
        self._out = ArrayMeta(shape, dtype)
        super().__init__([array("output", shape, dtype, "o"), array("input", meta.shape, meta.dtype)])

    def _build(self, spark, arrays, scalars):
        power = F.pow(cplx.squared(F.col("v"), self._meta.dtype), F.lit(self._order / 2))
        total = Reduce(self._wide, sum_of("float64"), self._axes).call(input=arrays["input"].with_value(power, "float64"))
        return {"output": total.with_value(F.pow("v", F.lit(1 / self._order)).cast(spark_type(self._out.dtype)), self._out.dtype)}


