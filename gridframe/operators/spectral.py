"""Fourier and discrete harmonic transforms.

A lane (all elements along an axis, for one place on the others) that fits a task is
gathered to an array and transformed in Arrow batches. Longer lanes are transformed in
four steps over a rectangle of their index, so every task holds one side of it; a
length without such a rectangle is carried by a chirp to a power of two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import cplx
from ..chunks import Chunks, emitted
from ..grid import Grid
from ..meta import ArrayMeta, array, is_complex, normalize_axes, scalar, spark_type
from ..plans.computation import Computation, meta_of
from .linear import TILE, MatrixMul, multiplied, wide_dtype
from .rearrange import Transpose

#: Longest lane of one task (16 MB of complex values).
MAX_LANE = 1 << 20


def lanes(df, batch, at, real=False):
    """(batch, __p, re[, im]): lanes along ``at`` as parallel lists of places and parts, in any order."""
    part = lambda c: F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))
    parts = {"re": "v"} if real else {"re": "v.re", "im": "v.im"}
    return df.groupBy(*batch).agg(F.collect_list(F.col(at).cast("int")).alias("__p"), *[part(c).alias(n) for n, c in parts.items()])


def map_lanes(df, batch, at, function, kind, real=False, keep=None, real_out=False):
    """Rows (keep, at, v) of ``function(matrix of lanes, batch columns)``; lanes of one length at a time.

    The function gives a matrix of values, a row for each lane, or (index, values) if
    places are not 0, 1, ...; ``real`` lanes, and results with ``real_out``, have no imaginary part.
    ``keep`` are the batch columns that stay (all by default).
    """
    keep = batch if keep is None else keep

    def run(batches):
        for part in batches:
            if not part.num_rows:
                continue
            place = part.column("__p")
            offsets = place.offsets.to_numpy()
            starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
            inside = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False)
            flat = inside("re") if real else inside("re") + 1j * inside("im")
            place = place.flatten().to_numpy(zero_copy_only=False)
            keys = {c: part.column(c).to_numpy() for c in batch}
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                cells = starts[rows][:, None] + np.arange(n)
                matrix = np.empty((len(rows), n), flat.dtype)
                matrix[np.arange(len(rows))[:, None], place[cells]] = flat[cells]
                own = {c: k[rows] for c, k in keys.items()}
                index, out = found if isinstance(found := function(matrix, own), tuple) else (None, found)
                width, flat_out = out.shape[1], out.ravel()
                index = np.tile(np.arange(width), len(rows)) if index is None else np.broadcast_to(index, out.shape).ravel()
                if not real_out:
                    value = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat_out.real).astype(kind)), pa.array(np.ascontiguousarray(flat_out.imag).astype(kind))], names=["re", "im"])
                else:
                    value = pa.array(flat_out.astype(kind))
                arrays = [pa.array(np.repeat(own[c], width)) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.ascontiguousarray(index, np.int64)), value], names=[*keep, at, "v"])

    sql = "float" if kind == "float32" else "double"
    value = sql if real_out else f"struct<re:{sql},im:{sql}>"
    schema = ", ".join([*(f"{c} bigint" for c in keep), f"{at} bigint", f"v {value}"])
    return lanes(df, batch, at, real).mapInArrow(run, schema)


def rectangle(n: int, most: int) -> tuple[int, int] | None:
    """Sides (a, b) with a * b = n, both within ``most``."""
    for a in range(math.isqrt(n), 0, -1):
        if n % a == 0 and n // a <= most:
            return a, n // a
    return None


def transform_axis(df, batch, at, n, inverse, kind, most):
    """DFT along ``at`` (length n), normalised by 1/n if inverse."""
    fft = np.fft.ifft if inverse else np.fft.fft
    if n <= most:
        return map_lanes(df, batch, at, lambda z, keys: fft(z, axis=1), kind)
    sides = rectangle(n, most)
    sign = 1 if inverse else -1
    if sides is None:
        return chirp_axis(df, batch, at, n, inverse, kind, most)
    a, b = sides
    # index = p * b + q; transform over p, twiddle, then over q: k = k1 + a * k2
    div = lambda c, s: F.call_function("div", c, F.lit(s).cast("bigint"))
    cut = df.select(*batch, F.pmod(F.col(at), F.lit(b).cast("bigint")).alias("__q"), div(F.col(at), b).alias("__p"), "v")

    def first(z, keys):
        twiddle = np.exp(sign * 2j * np.pi * keys["__q"][:, None] * np.arange(z.shape[1]) / n)
        return fft(z, axis=1) * twiddle

    step = map_lanes(cut, [*batch, "__q"], "__p", first, "float64").withColumnRenamed("__p", "__k1")
    done = map_lanes(step, [*batch, "__k1"], "__q", lambda z, keys: fft(z, axis=1), kind)
    return done.select(*batch, (F.col("__k1") + F.lit(a).cast("bigint") * F.col("__q")).alias(at), "v")


def chirp_axis(df, batch, at, n, inverse, kind, most):
    """A length without a rectangle, as a convolution of a power of two that has one."""
    sign = 1 if inverse else -1
    size = 1 << (2 * n - 1).bit_length()
    if rectangle(size, most) is None:
        raise ValueError(f"a lane of {n} elements is too long for tasks of {most}")
    spark = df.sparkSession
    angle = lambda k: F.pmod(k * k, F.lit(2 * n).cast("bigint")) * F.lit(math.pi / n)

    def turned(c, theta):
        re, im = F.col(c)["re"].cast("double"), F.col(c)["im"].cast("double")
        return F.struct((re * F.cos(theta) - im * F.sin(theta)).alias("re"), (re * F.sin(theta) + im * F.cos(theta)).alias("im"))

    k = F.col(at)
    signal = df.select(*batch, at, turned("v", sign * angle(k)).alias("v"))
    ends = df.where(k == n - 1).select(*batch, F.explode(F.sequence(F.lit(n).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias(at))
    padded = signal.unionByName(ends.withColumn("v", F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))))
    m = F.least(F.col("id"), F.lit(size) - F.col("id"))
    chirp = spark.range(size).select(F.col("id").alias(at), F.when(m < n, F.struct(F.cos(-sign * angle(m)).alias("re"), F.sin(-sign * angle(m)).alias("im"))).otherwise(F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))).alias("v"))
    left = transform_axis(padded, batch, at, size, False, "float64", most)
    right = transform_axis(chirp, [], at, size, False, "float64", most).select(F.col(at).alias("__c"), F.col("v").alias("__w"))
    re = F.col("v.re") * F.col("__w.re") - F.col("v.im") * F.col("__w.im")
    im = F.col("v.re") * F.col("__w.im") + F.col("v.im") * F.col("__w.re")
    product = left.join(right, F.col(at) == F.col("__c")).select(*batch, at, F.struct(re.alias("re"), im.alias("im")).alias("v"))
    back = transform_axis(product, batch, at, size, True, "float64", most).where(F.col(at) < n)
    out = back.select(*batch, at, turned("v", sign * angle(k)).alias("v"))
    scale = 1.0 / n if inverse else 1.0
    part = "float" if kind == "float32" else "double"
    return out.select(*batch, at, F.struct((F.col("v.re") * scale).cast(part).alias("re"), (F.col("v.im") * scale).cast(part).alias("im")).alias("v"))


# ------------------------------------------------------------ real lanes


def mirrored(n: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (a, b): X[k] = a Z[k] + b conj(Z[n/2 - k]), Z the transform of even samples + i odd samples; their conjugates lead back."""
    turn = np.exp(-2j * np.pi * k / n)
    return 0.5 * (1 - 1j * turn), 0.5 * (1 + 1j * turn)


def real_axis(df, batch, at, n, kind, most):
    """The first n/2 + 1 elements of the transform of real lanes along ``at`` (even length n).

    Two samples are one complex element, so the transform has half the length. In four steps
    over a rectangle (a, b) of that length, k = k1 + a k2 meets its mirror n/2 - k
    in lane a - k1; both lanes go to one task, which recombines them.
    """
    m = n // 2
    if n <= most:
        return map_lanes(df, batch, at, lambda x, keys: np.fft.rfft(x, axis=1), kind, real=True)
    half = lambda c, s: F.call_function("div", c, F.lit(s).cast("bigint"))
    sides = rectangle(m, most // 2)
    if sides is None:
        pairs = df.groupBy(*batch, half(F.col(at), 2).alias("__k")).agg(*[F.max(F.when(F.pmod(at, F.lit(2)) == j, F.col("v").cast("double"))).alias(c) for j, c in enumerate(("re", "im"))])
        packed = transform_axis(pairs.select(*batch, F.col("__k").alias(at), F.struct("re", "im").alias("v")), batch, at, m, False, "float64", most)
        return recombined(packed, batch, at, n, kind)
    a, b = sides
    pair = half(F.col(at), 2)
    cut = df.select(*batch, F.pmod(pair, F.lit(b).cast("bigint")).alias("__q"), (half(pair, b) * 2 + F.pmod(at, F.lit(2))).alias("__p"), "v")

    def first(x, keys):
        twiddle = np.exp(-2j * np.pi * keys["__q"][:, None] * np.arange(a) / m)
        return np.fft.fft(x[:, 0::2] + 1j * x[:, 1::2], axis=1) * twiddle

    step = map_lanes(cut, [*batch, "__q"], "__p", first, "float64", real=True)
    lane = F.least("__p", F.pmod(F.lit(a) - F.col("__p"), F.lit(a).cast("bigint")))
    both = step.select(*batch, lane.alias("__g"), F.when(F.col("__p") == lane, F.col("__q")).otherwise(F.col("__q") + b).alias(at), "v")

    def second(z, keys):
        g, k2 = keys["__g"][:, None], np.arange(b)
        if z.shape[1] == b:  # a lane that is its own mirror
            full, k = np.fft.fft(z, axis=1), g + a * k2
            there = np.take_along_axis(full, ((m - k) % m - g) // a % b, axis=1)
        else:
            full = np.concatenate((np.fft.fft(z[:, :b], axis=1), np.fft.fft(z[:, b:], axis=1)), axis=1)
            k = np.concatenate((g + a * k2, (a - g) + a * k2), axis=1)
            there = np.concatenate((full[:, : b - 1 : -1], full[:, b - 1 :: -1]), axis=1)
        one, two = mirrored(n, k)
        out = one * full + two * np.conj(there)
        if z.shape[1] == b:  # only lane 0 has the middle, which its first element gives; elsewhere that place is doubled
            middle = np.where(g == 0, full[:, :1].real - full[:, :1].imag, out[:, :1])
            k, out = np.concatenate((k, np.where(g == 0, m, -1)), axis=1), np.concatenate((out, middle), axis=1)
        return k, out

    return map_lanes(both, [*batch, "__g"], at, second, kind, keep=batch).where(F.col(at) >= 0)


def recombined(packed, batch, at, n, kind):
    """Mirror pairs of a packed transform, met by a grouping; for lengths without a rectangle."""
    m = n // 2
    low = F.least(F.col(at), F.pmod(F.lit(m) - F.col(at), F.lit(m).cast("bigint")))
    met = packed.groupBy(*batch, low.alias("__low")).agg(F.min_by("v", at).alias("z"), F.max_by("v", at).alias("y"))
    part = "float" if kind == "float32" else "double"

    def value(k, z, y):
        c, s = F.cos(k * (2 * math.pi / n)), F.sin(k * (2 * math.pi / n))
        er, ei, dr, di = (z["re"] + y["re"]) / 2, (z["im"] - y["im"]) / 2, (z["re"] - y["re"]) / 2, (z["im"] + y["im"]) / 2
        # even part, and odd part (d / i) turned by -2 pi k / n
        return F.struct((er + di * c - dr * s).cast(part).alias("re"), (ei - dr * c - di * s).cast(part).alias("im"))

    k, z, y = F.col("__low"), F.col("z"), F.col("y")
    other = F.lit(m).cast("bigint") - k
    own, there = F.struct(k.alias("k"), value(k, z, y).alias("v")), F.struct(other.alias("k"), value(other, y, z).alias("v"))
    both = F.when(k == other, F.array(own)).otherwise(F.array(own, there))
    return met.select(*batch, F.explode(both).alias("x")).select(*batch, F.col("x.k").alias(at), F.col("x.v").alias("v"))


def inverse_real_axis(df, batch, at, n, kind, most):
    """Real lanes of even length n along ``at`` from the first n/2 + 1 elements of their transform; mirrors as in ``real_axis``."""
    m = n // 2
    if n <= most:
        return map_lanes(df, batch, at, lambda z, keys: np.fft.irfft(z, n, axis=1), kind, real_out=True)
    half = lambda c, s: F.call_function("div", c, F.lit(s).cast("bigint"))
    sides = rectangle(m, most // 2)
    if sides is None:
        return None
    a, b = sides
    k = F.col(at)
    q = F.pmod(k, F.lit(b).cast("bigint"))
    p = half(k, b)  # the middle element is place a of lane 0
    lane = F.least(q, F.pmod(F.lit(b) - q, F.lit(b).cast("bigint")))
    both = df.select(*batch, lane.alias("__g"), F.when(q == lane, p).otherwise(p + a).alias("__p"), "v")

    def first(x, keys):
        g, p = keys["__g"][:, None], np.arange(a)
        if x.shape[1] == a + 1:  # lane 0, with the middle
            x[:, [0, a]] = x[:, [0, a]].real
            own, there, q = x[:, :a], x[:, :0:-1], np.zeros((len(g), 1), np.int64)
        elif x.shape[1] == a:
            own, there, q = x, x[:, ::-1], g
        else:
            own, there, q = x, np.concatenate((x[:, : a - 1 : -1], x[:, a - 1 :: -1]), axis=1), None
        k = p * b + q if q is not None else np.concatenate((p * b + g, p * b + (b - g)), axis=1)
        one, two = mirrored(n, k)
        z = np.conj(one) * own + np.conj(two) * np.conj(there)
        lanes_q = [q] if q is not None else [g, b - g]
        out = [np.fft.ifft(z[:, j * a : (j + 1) * a], axis=1) * np.exp(2j * np.pi * lane_q * p / m) for j, lane_q in enumerate(lanes_q)]
        return np.concatenate([lane_q * a + p for lane_q in lanes_q], axis=1), np.concatenate(out, axis=1)

    step = map_lanes(both, [*batch, "__g"], "__p", first, "float64", keep=batch)
    split = step.select(*batch, F.pmod("__p", F.lit(a).cast("bigint")).alias("__n1"), half(F.col("__p"), a).alias(at), "v")

    def second(z, keys):
        out = np.fft.ifft(z, axis=1)
        place = 2 * (keys["__n1"][:, None] + a * np.arange(b))
        return np.concatenate((place, place + 1), axis=1), np.concatenate((out.real, out.imag), axis=1)

    return map_lanes(split, [*batch, "__n1"], at, second, kind, keep=batch, real_out=True)


class FFT(Computation):
    """Discrete Fourier transform over axes; ``inverse`` divides by the lengths."""

    def __init__(self, arr, axes=None, max_lane: int = MAX_LANE):
        self._meta = meta = meta_of(arr)
        if not is_complex(meta.dtype):
            raise ValueError("FFT computation requires array of a complex dtype")
        self._axes, self._max = normalize_axes(meta.ndim, axes), max_lane
        super().__init__([array("output", meta.shape, meta.dtype, "o"), array("input", meta.shape, meta.dtype), scalar("inverse", "int32", 0)])

    def _build(self, spark, arrays, scalars):
        df, kind = arrays["input"].df, "float32" if self._meta.dtype == "complex64" else "float64"
        live = [a for a in self._axes if self._meta.shape[a] > 1]
        for number, axis in enumerate(live):
            rest = [f"i{k}" for k in range(self._meta.ndim) if k != axis]
            df = transform_axis(df, rest, f"i{axis}", self._meta.shape[axis], bool(scalars["inverse"]), kind if number == len(live) - 1 else "float64", self._max)
        return {"output": Grid(df, self._meta)}


# ------------------------------------------------------------ harmonic transform


#: Where the scaled recurrence is brought back, and by how much.
LARGE, STEP = 1e150, 1e-150


def hermite_rows(x: np.ndarray) -> Iterator[np.ndarray]:
    """Oscillator eigenfunctions 0, 1, ... at ``x``, by their recurrence; scaled, as exp(-x^2/2) leaves the range of doubles."""
    last, own = np.zeros(len(x)), np.full(len(x), np.pi**-0.25)
    power = -(x**2) / 2
    m = 0
    while True:
        yield own * np.exp(power)
        m += 1
        last, own = own, np.sqrt(2.0 / m) * x * own - np.sqrt((m - 1) / m) * last
        large = np.abs(own) > LARGE
        if large.any():
            own[large] *= STEP
            last[large] *= STEP
            power[large] -= math.log(STEP)


def hermite_pair(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenfunctions n - 1 and n at ``x``, each over the same factor."""
    last, own = np.zeros(len(x)), np.ones(len(x))
    for m in range(1, n + 1):
        last, own = own, np.sqrt(2.0 / m) * x * own - np.sqrt((m - 1) / m) * last
        large = np.abs(own) > LARGE
        own[large] *= STEP
        last[large] *= STEP
    return last, own


def hermite_functions(modes: int, x: np.ndarray) -> np.ndarray:
    """Oscillator eigenfunctions 0 .. modes-1 at ``x``, one row a mode."""
    return np.array(list(islice(hermite_rows(x), modes))) if modes else np.zeros((0, len(x)))


def hermite_roots(n: int, index: np.ndarray) -> np.ndarray:
    """Roots of the n-th Hermite polynomial by their number, ascending; any of them without the others.

    The i-th largest has the phase (i - 1/4) pi between it and the turning point, which gives
    starts within a hundredth of the roots' distance; Newton steps on the recurrence follow.
    """
    index = np.asarray(index)
    i = np.minimum(index, n - 1 - index) + 1  # roots are symmetric
    width = 2 * n + 1
    phase = (4 * i - 1) * np.pi / width
    turn = np.minimum(np.cbrt(6 * phase), np.pi)
    for _ in range(50):
        turn = np.clip(turn - (turn - np.sin(turn) - phase) / np.maximum(1 - np.cos(turn), 1e-12), 1e-9, np.pi)
    x = np.sqrt(width) * np.cos(turn / 2)
    for _ in range(4):
        below, own = hermite_pair(n, x)
        x = x - own / (np.sqrt(2.0 * n) * below - x * own)
    x[2 * i == n + 1] = 0.0
    return np.where(index < n - 1 - index, -x, x)


def gauss_hermite(points: int, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Roots (of these numbers, or all), and weights times exp(root squared) (which stay in range for many points)."""
    roots = hermite_roots(points, np.arange(points) if index is None else index)
    last = next(islice(hermite_rows(roots), points - 1, None))
    return roots, 1.0 / (points * last**2)


def spatial_points(modes: int, order: int, add_points: int = 0) -> int:
    return ((modes - 1) * (order + 1)) // 2 + 1 + add_points


def spatial_grid(modes: int, order: int, add_points: int = 0, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights (of these numbers, or all) at which the ``order``-th power of a function is transformed exactly."""
    roots, weights = gauss_hermite(spatial_points(modes, order, add_points), index)
    scale = math.sqrt(2.0 / (order + 1))
    return roots * scale, weights * scale


def dht_matrix(modes: int, order: int, add_points: int, inverse: bool) -> np.ndarray:
    """(coordinates, modes) for the forward transform, (modes, coordinates) for the inverse."""
    x, w = spatial_grid(modes, order, add_points)
    p = hermite_functions(modes, x)
    return p if inverse else (p * w).T


#: Elements of a transform's matrix that the driver makes; a larger one comes from tasks, tile by tile.
SMALL_MATRIX = 1 << 16


def dht_tiles(spark, modes: int, order: int, add_points: int, inverse: bool, tile: int):
    """The transform's matrix as pieces of tiles: a task makes the points of a block, then their functions, mode after mode."""
    points = spatial_points(modes, order, add_points)
    names = [f"{p}{k}" for p in "cos" for k in range(3)]

    def run(batches):
        def rows():
            for batch in batches:
                for block in batch.column("id").to_pylist():
                    first, end = block * tile, min(points, (block + 1) * tile)
                    x, w = spatial_grid(modes, order, add_points, np.arange(first, end))
                    functions = hermite_rows(x)
                    for number in range(-(-modes // tile)):
                        size = min(tile, modes - number * tile)
                        part = np.array(list(islice(functions, size)))
                        shape = (size, end - first) if inverse else (end - first, size)
                        at = (0, number, block) if inverse else (0, block, number)
                        yield (*at, 0, 0, 0, 1, *shape), part if inverse else (part * w).T

        yield from emitted(rows(), names, "float64")

    blocks = -(-points // tile)
    return spark.range(0, blocks, 1, min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, ", ".join([*(f"{n} bigint" for n in names), "v array<double>"]))


class DHT(Computation):
    """Gauss-Hermite transform between coordinates and oscillator modes, axis by axis.

    A matrix over ``SMALL_MATRIX`` elements is made where its tiles are multiplied; nothing of
    its size is on the driver.
    """

    def __init__(self, mode_arr, add_points=None, inverse: bool = False, order: int = 1, axes=None):
        meta = meta_of(mode_arr)
        if inverse and order != 1:
            raise ValueError("The inverse transform is defined for the first order only")
        self._axes, self._order, self._inverse = normalize_axes(meta.ndim, axes), order, inverse
        self._add = tuple(add_points) if add_points is not None else (0,) * meta.ndim
        coord_shape = tuple(spatial_points(n, order, self._add[k]) if k in self._axes else n for k, n in enumerate(meta.shape))
        self._modes, self._coords = meta, ArrayMeta(coord_shape, meta.dtype)
        modes, points = array("modes", meta.shape, meta.dtype, "i" if inverse else "o"), array("coords", coord_shape, meta.dtype, "o" if inverse else "i")
        super().__init__([points, modes] if inverse else [modes, points])

    def _build(self, spark, arrays, scalars):
        grid = arrays["modes" if self._inverse else "coords"]
        real = "float32" if self._modes.dtype in ("float32", "complex64") else "float64"
        for axis in self._axes:
            order = [k for k in range(grid.meta.ndim) if k != axis] + [axis]
            turned = Transpose(grid, order).call(input=grid)
            n = turned.meta.shape[-1]
            rows = turned.reshape((turned.meta.size // n, n))
            made = (self._modes.shape[axis], self._order, self._add[axis], self._inverse)
            width = self._coords.shape[axis] if self._inverse else self._modes.shape[axis]
            if n * width <= SMALL_MATRIX:
                matrix = Grid.from_numpy(spark, dht_matrix(*made), "float64")
                matrix = matrix.with_value(F.col("v").cast(spark_type(real)), real)
                product = MatrixMul(rows, matrix).call(matrix_a=rows, matrix_b=matrix)
            else:
                product = self._by_tiles(rows, dht_tiles(spark, *made, TILE), width)
            product = Grid(product.df.withColumn("v", F.col("v").cast(spark_type(self._modes.dtype))), product.meta.with_dtype(self._modes.dtype))
            shaped = product.reshape((*turned.meta.shape[:-1], product.meta.shape[-1]))
            grid = Transpose(shaped, [order.index(k) for k in range(len(order))]).call(input=shaped)
        return {"coords" if self._inverse else "modes": grid}

    def _by_tiles(self, rows: Grid, tiles, width: int) -> Grid:
        """``rows`` times a matrix of tiles."""
        (m, n), dtype = rows.meta.shape, rows.meta.dtype
        wide = wide_dtype(dtype)
        cut = Chunks.from_grid(rows.reshape((1, m, n)), (1, TILE, TILE))
        whole = [F.lit(0).cast("bigint").alias(f"o{k}") for k in range(3)] + [s.alias(f"s{k}") for k, s in enumerate(cut.sizes())]
        sums = multiplied(cut.df.select(*cut.names, *whole, "v"), tiles, (1, m, n, width), (dtype, "float64"), (1, 1), TILE, wide)
        out = Chunks(sums.select(F.col("bi").alias("c0"), F.col("bj").alias("c1"), "v"), ArrayMeta((m, width), wide), (TILE, TILE)).to_grid()
        return out.with_value(cplx.cast(F.col("v"), wide, dtype), dtype)
