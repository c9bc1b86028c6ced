"""Folds over axes: reduction, prefix scan and difference with a monoid.

A monoid with a Catalyst aggregate reduces by partial aggregation. Another one is folded where
it is read: the rows of a partition are packed to arrays (``pack_partition``), which the
operation folds as an expression; only the results are shuffled, and folded in blocks
of ``BLOCK``, level by level, so no group grows with the data.

A scan deals a lane to segments of consecutive elements. Totals of segments come from the
data as it lies; their exclusive scan gives each segment the element it starts from, which
is put before its own as one more row. So one shuffle of the data, sorted by segment and
place, gives all prefixes in one pass, with no window, and without a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .. import cplx
from ..grid import Grid
from ..meta import ArrayMeta, array, is_complex, normalize_axes, real_of, spark_type
from ..plans.computation import Computation, literal, meta_of
from ..plans.shelf import shared

#: Elements folded as one array, and the shortest segment of a scan.
BLOCK = 4096
#: Segments of a lane whose prefixes are streamed; their totals are all that is left for the next level.
SEGMENTS = 1024
#: Rows of a partition that are packed together.
PACK_ROWS = 1 << 16


@dataclass(frozen=True)
class Monoid:
    """An associative operation on columns with its identity.

    ``native(value, over)`` is an expression of Catalyst aggregates for it; ``over`` is
    applied to each of them (nothing for a group, a window for a scan). ``accumulate`` is numpy's
    name of the operation on plain numbers, ``minus`` undoes it on the right side. The elements
    of a ``commutative`` one may be folded in any order.
    """

    op: Callable[[Column, Column], Column]
    empty: object
    dtype: str
    native: Callable[[Column, Callable[[Column], Column]], Column] | None = None
    accumulate: str | None = None
    minus: Callable[[Column, Column], Column] | None = None
    commutative: bool = False

    @property
    def zero(self) -> Column:
        return literal(self.empty, self.dtype).cast(spark_type(self.dtype))


def sum_of(dtype: str) -> Monoid:
    """Addition; complex values by parts."""
    if is_complex(dtype):
        less = lambda a, b: cplx.make(a["re"] - b["re"], a["im"] - b["im"], dtype)
        return Monoid(lambda a, b: cplx.add(a, dtype, b, dtype, dtype), 0, dtype, lambda v, over: cplx.make(over(F.sum(v["re"].cast("double"))), over(F.sum(v["im"].cast("double"))), dtype), "add", less, True)
    return Monoid(lambda a, b: (a + b).cast(spark_type(dtype)), 0, dtype, lambda v, over: over(F.sum(v)).cast(spark_type(dtype)), "add", lambda a, b: (a - b).cast(spark_type(dtype)), True)


def min_of(dtype: str, empty: object) -> Monoid:
    return Monoid(F.least, empty, dtype, lambda v, over: over(F.min(v)), "fmin", commutative=True)


def max_of(dtype: str, empty: object) -> Monoid:
    return Monoid(F.greatest, empty, dtype, lambda v, over: over(F.max(v)), "maximum", commutative=True)


def min_max(empty_min: int = 1 << 30, empty_max: int = -(1 << 30), part: str = "int") -> Monoid:
    """Smallest and greatest of structs (cur_min, cur_max)."""
    dtype = f"struct<cur_min:{part},cur_max:{part}>"
    pair = lambda a, b: F.struct(a.alias("cur_min"), b.alias("cur_max"))
    return Monoid(lambda a, b: pair(F.least(a["cur_min"], b["cur_min"]), F.greatest(a["cur_max"], b["cur_max"])), {"cur_min": empty_min, "cur_max": empty_max}, dtype, lambda v, over: pair(over(F.min(v["cur_min"])), over(F.max(v["cur_max"]))), commutative=True)


def _same_kind(monoid: Monoid, dtype: str) -> None:
    if spark_type(monoid.dtype) != spark_type(dtype):
        raise ValueError("The predicate and the array must use the same data type")


class Reduce(Computation):
    """Fold over axes, which stay with size 1. Rows of a group may meet in any order."""

    def __init__(self, arr, monoid: Monoid, axes=None):
        self._meta = meta = meta_of(arr)
        self._axes = normalize_axes(meta.ndim, axes)
        self._monoid = monoid
        _same_kind(monoid, meta.dtype)
        self._shape = tuple(1 if k in self._axes else n for k, n in enumerate(meta.shape))
        super().__init__([array("output", self._shape, meta.dtype, "o"), array("input", meta.shape, meta.dtype)])

    def _build(self, spark, arrays, scalars):
        grid, ndim = arrays["input"], self._meta.ndim
        if math.prod(self._meta.shape[a] for a in self._axes) == 1:
            return {"output": grid}
        rest = [f"i{k}" for k in range(ndim) if k not in self._axes]
        if self._monoid.native:
            out = grid.df.groupBy(*rest).agg(self._monoid.native(F.col("v"), lambda c: c).alias("v"))
        else:
            out = fold(grid.df, rest, flat_index([f"i{a}" for a in self._axes], [self._meta.shape[a] for a in self._axes]), math.prod(self._meta.shape[a] for a in self._axes), self._monoid)
        index = [F.lit(0).cast("bigint").alias(f"i{k}") if k in self._axes else F.col(f"i{k}") for k in range(ndim)]
        return {"output": Grid(out.select(*index, "v"), ArrayMeta(self._shape, self._meta.dtype))}


def flat_index(names: list[str], sizes: list[int]) -> Column:
    out = F.lit(0).cast("bigint")
    for name, n in zip(names, sizes):
        out = out * n + F.col(name)
    return out


def starts_of(columns: list[np.ndarray]) -> np.ndarray:
    """Rows that differ from the one before in one of the columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def listed(rows: pa.RecordBatch, first: np.ndarray, keys: list[str]) -> dict[str, pa.Array]:
    """Columns of one row a run: keys, ``__at`` of its first row and the list ``__l`` of its values."""
    heads = pa.array(first)
    values = rows.column("v")
    out = {c: rows.column(c).take(heads) for c in [*keys, "__at"]}
    return out | {"__l": pa.ListArray.from_arrays(pa.array(np.append(first, rows.num_rows), pa.int32()), values)}


def pack_partition(df: DataFrame, batch: list[str], commutative: bool) -> DataFrame:
    """(batch, __at, __n, __l): rows (batch, __at, __n, v) that lie in one partition as lists, in order; nothing is moved.

    A list holds rows that follow each other (``__n`` places each) or, for a commutative
    operation, all rows of a batch that are packed together.
    """
    value = df.schema["v"].dataType
    schema = StructType([StructField(c, LongType()) for c in (*batch, "__at", "__n")] + [StructField("__l", ArrayType(value))])

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().sort_by([(c, "ascending") for c in (*batch, "__at")]).combine_chunks().to_batches()[0]
        at, n = rows.column("__at").to_numpy(), rows.column("__n").to_numpy()
        keys = [rows.column(c).to_numpy() for c in batch]
        if not commutative:
            ends = np.cumsum(n)
            keys.append(at - (ends - n))  # the same along rows that follow each other
        first = starts_of(keys or [np.zeros(len(at), np.int8)])
        out = listed(rows, first, batch)
        return pa.RecordBatch.from_pydict({**{c: out[c] for c in (*batch, "__at")}, "__n": pa.array(np.add.reduceat(n, first)), "__l": out["__l"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in batches:
            if rows.num_rows:
                held.append(rows)
                size += rows.num_rows
            if size >= PACK_ROWS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return df.select(*batch, "__at", "__n", "v").mapInArrow(run, schema)


def partial_folds(df: DataFrame, batch: list[str], monoid: Monoid) -> DataFrame:
    """(batch, __at, v): what each partition of (batch, __at, v) comes to, one row a batch (and a gap in its places, where order counts)."""
    level = df.withColumn("__n", F.lit(1).cast("bigint"))
    for _ in range(2):  # runs of PACK_ROWS, then their results, of which a partition has few
        packed = pack_partition(level, batch, monoid.commutative)
        level = packed.select(*batch, "__at", "__n", F.aggregate("__l", monoid.zero, monoid.op).alias("v"))
    return level.select(*batch, "__at", "v")


def fold(df: DataFrame, batch: list[str], position: Column, size: int, monoid: Monoid) -> DataFrame:
    """(batch, v): ordered fold; in the partitions first, then their results by blocks, level by level."""
    level = partial_folds(df.select(*batch, position.alias("__at"), "v"), batch, monoid)
    while True:
        blocks = level.groupBy(*batch, F.call_function("div", F.col("__at"), F.lit(BLOCK).cast("bigint")).alias("__block")).agg(F.array_sort(F.collect_list(F.struct("__at", "v"))).alias("__l"))
        level = blocks.select(*batch, F.col("__block").alias("__at"), F.aggregate(F.transform("__l", lambda x: x["v"]), monoid.zero, monoid.op).alias("v"))
        size = -(-size // BLOCK)
        if size == 1:
            return level.select(*batch, "v")


class Scan(Computation):
    """Prefix fold over axes, flattened in the given order; inclusive or exclusive.

    Lanes longer than ``block`` elements are cut in segments of at least so many, whose
    totals are scanned by the same rule, so no task holds a lane.
    """

    def __init__(self, arr, monoid: Monoid, axes=None, exclusive: bool = False, block: int = BLOCK):
        self._meta = meta = meta_of(arr)
        self._axes = normalize_axes(meta.ndim, axes)
        self._monoid, self._exclusive, self._block = monoid, exclusive, block
        _same_kind(monoid, meta.dtype)
        super().__init__([array("output", meta.shape, meta.dtype, "o"), array("input", meta.shape, meta.dtype)])

    def _build(self, spark, arrays, scalars):
        meta, axes = self._meta, self._axes
        rest = [f"i{k}" for k in range(meta.ndim) if k not in axes]
        lane = ArrayMeta(tuple(meta.shape[a] for a in axes), "")
        at = flat_index([f"i{a}" for a in axes], list(lane.shape))
        out = scan(arrays["input"].df.select(*rest, at.alias("__at"), "v"), rest, lane.size, self._monoid, self._exclusive, self._block)
        own = {f"i{a}": F.pmod(F.call_function("div", F.col("__at"), F.lit(s).cast("bigint")), F.lit(n).cast("bigint")) for a, n, s in zip(axes, lane.shape, lane.strides)}
        return {"output": Grid(out.withColumns(own), meta)}


def scan(df: DataFrame, batch: list[str], size: int, monoid: Monoid, exclusive: bool, block: int = BLOCK) -> DataFrame:
    """(batch, __at, v) with v scanned along __at, which is below ``size``."""
    streamed = is_plain(monoid)
    if size <= block:
        return (running if streamed else running_lists)(df, batch, monoid, exclusive)
    df = shared(df)  # read for the totals and for the prefixes
    length = max(block, -(-size // SEGMENTS)) if streamed else block
    cut = df.withColumn("__segment", F.call_function("div", F.col("__at"), F.lit(length).cast("bigint")))
    keys = [*batch, "__segment"]
    if monoid.native:
        totals = cut.groupBy(*keys).agg(monoid.native(F.col("v"), lambda c: c).alias("v"))
    else:
        totals = fold(cut, keys, F.col("__at") - F.col("__segment") * length, length, monoid)
    starts = scan(totals.select(*batch, F.col("__segment").alias("__at"), "v"), batch, -(-size // length), monoid, True, block)
    before = starts.select(*batch, F.col("__at").alias("__segment"), F.lit(-1).cast("bigint").alias("__at"), "v")
    out = (running if streamed else running_lists)(cut.unionByName(before), keys, monoid, exclusive)
    return out.where(F.col("__at") >= 0).drop("__segment")


def is_plain(monoid: Monoid) -> bool:
    """Whether numpy can accumulate it as Catalyst would."""
    return monoid.accumulate is not None and spark_type(real_of(monoid.dtype) if is_complex(monoid.dtype) else monoid.dtype) in ("tinyint", "smallint", "int", "bigint", "float", "double")


def by_segment(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the same keys together, in the order of __at."""
    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, "__at")


def running(df: DataFrame, keys: list[str], monoid: Monoid, exclusive: bool) -> DataFrame:
    """Prefixes of plain numbers along __at, streamed: a task holds a batch and one carried value."""
    dtype = spark_type(monoid.dtype)
    wide = "double" if is_complex(monoid.dtype) or dtype in ("float", "double") else "bigint"
    parts = ["__re", "__im"] if is_complex(monoid.dtype) else ["__re"]
    own = {"__re": "v.re", "__im": "v.im"} if is_complex(monoid.dtype) else {"__re": "v"}
    columns = [*keys, "__at"]
    source = by_segment(df.withColumn("v", F.coalesce("v", monoid.zero)).select(*columns, *[F.col(c).cast(wide).alias(n) for n, c in own.items()]), keys)
    operation, kind = monoid.accumulate, np.float64 if wide == "double" else np.int64
    empty = complex(monoid.empty) if is_complex(monoid.dtype) else monoid.empty
    zeros = [empty.real, empty.imag] if is_complex(monoid.dtype) else [empty]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, last, carried = getattr(np, operation), None, None
        for rows in batches:
            if not rows.num_rows:
                continue
            named = [rows.column(c).to_numpy() for c in keys]
            first = starts_of(named or [np.zeros(rows.num_rows, np.int8)]).tolist()
            out = [np.empty(rows.num_rows, kind) for _ in parts]
            goes_on = last is not None and last == tuple(c[0] for c in named)
            values = [rows.column(c).to_numpy() for c in parts]
            for s, e in zip(first, [*first[1:], rows.num_rows]):
                for k, (v, o, zero) in enumerate(zip(values, out, zeros)):
                    total = add.accumulate(v[s:e] if s or not goes_on else np.concatenate(([carried[k]], v[s:e])))
                    if s or not goes_on:
                        o[s:e] = total if not exclusive else np.concatenate((np.array([zero], kind), total[:-1]))
                    else:
                        o[s:e] = total[:-1] if exclusive else total[1:]
                    if e == rows.num_rows:
                        carried = carried if k else [None] * len(parts)
                        carried[k] = total[-1]
            last = tuple(c[-1] for c in named)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *map(pa.array, out)], names=[*columns, *parts])

    found = source.mapInArrow(run, ", ".join([*(f"{c} bigint" for c in columns), *(f"{p} {wide}" for p in parts)]))
    v = cplx.make(F.col("__re"), F.col("__im"), monoid.dtype) if is_complex(monoid.dtype) else F.col("__re").cast(dtype)
    return found.select(*columns, v.alias("v"))


def running_lists(df: DataFrame, keys: list[str], monoid: Monoid, exclusive: bool) -> DataFrame:
    """Prefixes of any operation along __at: each segment (a block and its start at most) is a list, whose prefixes are an expression."""
    value = df.schema["v"].dataType
    columns = [*keys, "__at"]
    schema = StructType([StructField(c, LongType()) for c in keys] + [StructField("__places", ArrayType(LongType())), StructField("__l", ArrayType(value))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def packed(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
            out = listed(rows, first, keys)
            places = pa.ListArray.from_arrays(out["__l"].offsets, rows.column("__at"))
            return pa.RecordBatch.from_pydict({**{c: out[c] for c in keys}, "__places": places, "__l": out["__l"]})

        for rows in batches:
            if held is not None:
                rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            first = starts_of([rows.column(c).to_numpy() for c in keys] or [np.zeros(rows.num_rows, np.int8)])
            if len(first) > 1:
                yield packed(rows.slice(0, int(first[-1])), first[:-1])
            held = rows.slice(int(first[-1]))
        if held is not None:
            yield packed(held, np.zeros(1, np.int64))

    lists = by_segment(df.select(*columns, "v"), keys).mapInArrow(run, schema)
    grown = lists.select(*keys, "__places", prefixes("__l", monoid).alias("__prefix")).select(*keys, F.posexplode("__places").alias("__n", "__at"), "__prefix")
    return grown.select(*columns, F.get("__prefix", F.col("__n") + F.lit(0 if exclusive else 1)).alias("v"))


class Difference(Computation):
    """What a scan along axes has added at each place: v[k] - v[k-1], and v[0]; the inverse of an inclusive scan.

    Each block of a lane also gets the last element of the one before, so one shuffle by
    blocks is all that moves.
    """

    def __init__(self, arr, monoid: Monoid, axes=None, block: int = BLOCK):
        self._meta = meta = meta_of(arr)
        self._axes = normalize_axes(meta.ndim, axes)
        self._monoid, self._block = monoid, block
        _same_kind(monoid, meta.dtype)
        if monoid.minus is None:
            raise ValueError("The predicate has no inverse")
        super().__init__([array("output", meta.shape, meta.dtype, "o"), array("input", meta.shape, meta.dtype)])

    def _build(self, spark, arrays, scalars):
        meta, monoid, length = self._meta, self._monoid, F.lit(self._block).cast("bigint")
        index = [f"i{k}" for k in range(meta.ndim)]
        rest = [f"i{k}" for k in range(meta.ndim) if k not in self._axes]
        at = flat_index([f"i{a}" for a in self._axes], [meta.shape[a] for a in self._axes])
        block = F.call_function("div", at, length)
        both = F.when(F.pmod(at, length) == self._block - 1, F.array(block, block + 1)).otherwise(F.array(block))
        cut = arrays["input"].df.select(*index, "v", at.alias("__at"), F.explode(both).alias("__block"))
        before = F.lag("v").over(Window.partitionBy(*rest, "__block").orderBy("__at"))
        met = cut.withColumn("__before", before).where(F.call_function("div", F.col("__at"), length) == F.col("__block"))
        v = F.when(F.col("__before").isNull(), F.col("v")).otherwise(monoid.minus(F.col("v"), F.col("__before")))
        return {"output": Grid(met.select(*index, v.alias("v")), meta)}


#: Elements of a lane whose prefixes are built by appending, which copies what is there.
CHUNK = 64


def prefixes(lane: str, monoid: Monoid) -> Column:
    """Array of the folds of the first 0, 1, ... elements of an array column, in chunks of ``CHUNK``."""

    def grown(x: Column) -> Column:
        return F.aggregate(x, F.array(monoid.zero), lambda acc, v: F.concat(acc, F.array(monoid.op(F.element_at(acc, -1), v))))

    count = F.call_function("div", F.size(lane) + F.lit(CHUNK - 1), F.lit(CHUNK)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda c: grown(F.slice(lane, c * CHUNK + 1, F.lit(CHUNK))))
    starts = F.aggregate(chunks, F.array(monoid.zero), lambda acc, c: F.concat(acc, F.array(monoid.op(F.element_at(acc, -1), F.element_at(c, -1)))))
    shifted = F.transform(F.arrays_zip(chunks.alias("c"), F.slice(starts, 1, F.size(starts) - 1).alias("s")), lambda z: F.transform(F.slice(z["c"], 2, F.size(z["c"]) - 1), lambda v: monoid.op(z["s"], v)))
    return F.concat(F.array(monoid.zero), F.flatten(shifted))
