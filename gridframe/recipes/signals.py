"""Composites of the operators: spectrogram, real transforms, transposed n-d transforms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .. import cplx
from ..functions.transforms import to_complex
from ..grid import Grid
from ..meta import COMPLEX_OF, ArrayMeta, real_of, spark_type
from ..operators.fold import Difference, Reduce, Scan, sum_of
from ..operators.rearrange import Transpose
from ..operators.spectral import FFT, MAX_LANE, inverse_real_axis, map_lanes, real_axis


def frames(signal: Grid, size: int, overlap: int, pad_to: int | None = None) -> Grid:
    """(frame, place): overlapping frames of a 1-d signal, zeros up to ``pad_to``.

    Each sample is sent to the frames that hold it; none is collected.
    """
    step, width = size - overlap, pad_to or size
    (n,) = signal.meta.shape
    count = (n - overlap) // step
    at = F.col("i0")
    first = F.greatest(F.lit(0).cast("bigint"), F.call_function("div", at - size + step, F.lit(step).cast("bigint")))
    last = F.least(F.lit(count - 1).cast("bigint"), F.call_function("div", at, F.lit(step).cast("bigint")))
    spread = signal.df.where(first <= last).select(F.explode(F.sequence(first, last)).alias("f"), "i0", "v")
    df = spread.select(F.col("f").alias("i0"), (at - F.col("f") * step).alias("i1"), "v").where((F.col("i1") >= 0) & (F.col("i1") < size))
    if width > size:
        zeros = df.sparkSession.range(count * (width - size)).select(F.call_function("div", F.col("id"), F.lit(width - size).cast("bigint")).alias("i0"), (F.pmod(F.col("id"), F.lit(width - size).cast("bigint")) + size).alias("i1"), F.lit(0).cast(spark_type(signal.meta.dtype)).alias("v"))
        df = df.unionByName(zeros)
    return Grid(df, ArrayMeta((count, width), signal.meta.dtype))


def spectrogram(signal: Grid, size: int = 256, overlap: int = 128, pad_to: int | None = None) -> Grid:
    """(frequency, frame): modulus of the transform of Hann-weighted frames."""
    cut = frames(signal, size, overlap, pad_to)
    width = cut.meta.shape[1]
    hann = F.lit(0.5) * (F.lit(1.0) - F.cos(F.col("i1") * F.lit(2 * math.pi / (size - 1))))
    weighted = cut.with_value((F.col("v") * hann).cast(spark_type(cut.meta.dtype)), cut.meta.dtype)
    kind = COMPLEX_OF[cut.meta.dtype]
    fft = FFT(ArrayMeta(cut.meta.shape, kind), axes=(1,))
    fft.connect("input", to_complex(weighted.meta), "output", signal="input")
    out = fft.call(signal=weighted)
    modulus = out.df.where(F.col("i1") < width // 2 + 1).select("i0", "i1", F.sqrt(cplx.squared(F.col("v"), kind)).cast(spark_type(real_of(kind))).alias("v"))
    grid = Grid(modulus, ArrayMeta((cut.meta.shape[0], width // 2 + 1), real_of(kind)))
    return Transpose(grid).call(input=grid)


def _last(grid: Grid) -> tuple[list[str], str]:
    """Coordinates before the last one, and the last one."""
    return [f"i{k}" for k in range(grid.meta.ndim - 1)], f"i{grid.meta.ndim - 1}"


def _pair(re, im):
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def _fft_last(df, shape: tuple[int, ...], inverse: int, max_lane: int) -> Grid:
    """Complex transform along the last axis."""
    grid = Grid(df, ArrayMeta(shape, "complex128"))
    return FFT(grid, axes=(-1,), max_lane=max_lane).call(input=grid, inverse=inverse)


def _cast_pair(grid: Grid, dtype: str) -> Grid:
    return grid.with_value(cplx.make(F.col("v.re"), F.col("v.im"), dtype), dtype)


def rfft(grid: Grid, max_lane: int = MAX_LANE) -> Grid:
    """Transform of real lanes: the first half and the middle; of even length by packing two samples in one."""
    n, (batch, at), dtype = grid.meta.shape[-1], _last(grid), COMPLEX_OF[grid.meta.dtype]
    meta = ArrayMeta((*grid.meta.shape[:-1], n // 2 + 1), dtype)
    if n % 2 == 0 and n > 2:
        return Grid(real_axis(grid.df, batch, at, n, real_of(dtype), max_lane), meta)
    full = _fft_last(grid.df.withColumn("v", _pair(F.col("v"), F.lit(0.0))), grid.meta.shape, 0, max_lane)
    return _cast_pair(Grid(full.df.where(F.col(at) < n // 2 + 1), meta.with_dtype("complex128")), dtype)


def irfft(grid: Grid, max_lane: int = MAX_LANE) -> Grid:
    """Real lanes of even length from their half transform; imaginary parts of the first and the last element are ignored."""
    n, (batch, at), dtype = 2 * (grid.meta.shape[-1] - 1), _last(grid), real_of(grid.meta.dtype)
    shape = (*grid.meta.shape[:-1], n)
    packed = inverse_real_axis(grid.df, batch, at, n, dtype, max_lane)
    if packed is not None:
        return Grid(packed, ArrayMeta(shape, dtype))
    # a length without a rectangle: mirrored to the whole transform
    end = F.col(at).isin(0, n // 2)
    own = F.struct(F.col(at).alias("k"), _pair(F.col("v.re"), F.when(end, F.lit(0.0)).otherwise(F.col("v.im"))).alias("v"))
    other = F.struct((F.lit(n).cast("bigint") - F.col(at)).alias("k"), _pair(F.col("v.re"), -F.col("v.im")).alias("v"))
    spread = grid.df.select(*batch, F.explode(F.when(end, F.array(own)).otherwise(F.array(own, other))).alias("x"))
    out = _fft_last(spread.select(*batch, F.col("x.k").alias(at), F.col("x.v").alias("v")), shape, 1, max_lane)
    return out.with_value(F.col("v.re").cast(spark_type(dtype)), dtype)


def aprfft(grid: Grid) -> Grid:
    """Odd harmonics of an antiperiodic real signal, from its first half (even length).

    Scaled signal, real transform, a weighted reduction for the first element, then a
    prefix scan.
    """
    n = 2 * grid.meta.shape[-1]
    at, dtype = f"i{grid.meta.ndim - 1}", COMPLEX_OF[grid.meta.dtype]
    angle = F.col(at) * F.lit(2 * math.pi / n)
    scaled = grid.with_value((F.col("v") * 4 * F.sin(angle)).cast(spark_type(grid.meta.dtype)), grid.meta.dtype)
    turned = rfft(scaled)
    half = Grid(turned.df.where(F.col(at) < n // 4), ArrayMeta((*turned.meta.shape[:-1], n // 4), dtype))
    half = half.with_value(cplx.mul(F.col("v"), dtype, cplx.constant(-1j, dtype), dtype, dtype), dtype)
    weighted = grid.with_value((F.col("v") * F.cos(angle)).cast("double"), "float64")
    total = Reduce(weighted, sum_of("float64"), axes=(-1,)).call(input=weighted)
    batch = [f"i{k}" for k in range(grid.meta.ndim - 1)]
    names = [f"__{c}" for c in batch]
    first = total.df.select(*[F.col(c).alias(m) for c, m in zip(batch, names)], F.col("v").alias("__s"))
    met = F.lit(True)
    for c, m in zip(batch, names):
        met = met & (F.col(c) == F.col(m))
    joined = half.df.join(first, met) if batch else half.df.crossJoin(F.broadcast(first))  # one row
    zero = F.col(at) == 0
    re = F.when(zero, F.col("v.re") / 2 + 2 * F.col("__s")).otherwise(F.col("v.re"))
    im = F.when(zero, F.col("v.im") / 2).otherwise(F.col("v.im"))
    start = Grid(joined.withColumn("v", cplx.make(re, im, dtype)), half.meta)
    return Scan(start, sum_of(dtype), axes=(-1,)).call(input=start)


def iaprfft(grid: Grid, max_lane: int = MAX_LANE) -> Grid:
    """First half of an antiperiodic real signal from its odd harmonics; inverse of ``aprfft``.

    Differences of neighbouring harmonics are the transform of the signal times a sine, of half
    the length; dividing by it gives all but the first element, which is a sum.
    """
    half, (batch, at), dtype = grid.meta.shape[-1], _last(grid), real_of(grid.meta.dtype)
    n = 4 * half  # period of the signal
    meta = ArrayMeta((*grid.meta.shape[:-1], 2 * half), dtype)
    scale = lambda k: 1 / (4 * np.sin(2 * np.pi * k / n))
    if 2 * half <= max_lane:

        def lane(x, keys):
            step = 1j * np.diff(x, axis=1)
            y = np.concatenate((-2 * x[:, :1].imag, step, 2 * x[:, -1:].imag), axis=1)
            out = np.fft.irfft(y, 2 * half, axis=1)
            return np.concatenate((x.real.sum(axis=1, keepdims=True) / (2 * half), out[:, 1:] * scale(np.arange(1, 2 * half))), axis=1)

        return Grid(map_lanes(grid.df, batch, at, lane, dtype, real_out=True), meta)
    wide = grid.with_value(_pair(F.col("v.re"), F.col("v.im")), "complex128")
    real = wide.with_value(F.col("v.re"), "float64")
    total = Reduce(real, sum_of("float64"), axes=(-1,)).call(input=real).df.withColumn("v", F.col("v") / (2 * half))
    step = Difference(wide, sum_of("complex128"), axes=(-1,)).call(input=wide)
    zero = F.lit(0.0)
    turned = F.when(F.col(at) == 0, _pair(-2 * F.col("v.im"), zero)).otherwise(_pair(-F.col("v.im"), F.col("v.re")))
    last = wide.df.where(F.col(at) == half - 1).select(*batch, F.lit(half).cast("bigint").alias(at), _pair(2 * F.col("v.im"), zero).alias("v"))
    y = Grid(step.df.withColumn("v", turned).unionByName(last), ArrayMeta((*grid.meta.shape[:-1], half + 1), "complex128"))
    out = irfft(y, max_lane).df.where(F.col(at) > 0)
    scaled = out.withColumn("v", F.col("v") / (4 * F.sin(F.col(at) * F.lit(2 * math.pi / n))))
    return Grid(scaled.unionByName(total), meta.with_dtype("float64")).with_value(F.col("v").cast(spark_type(dtype)), dtype)


def fftn_by_transposes(grid: Grid, axes: tuple[int, ...] | None = None) -> Grid:
    """n-d transform: each axis is brought innermost, transformed, and brought back."""
    for axis in axes if axes is not None else range(grid.meta.ndim):
        order = [k for k in range(grid.meta.ndim) if k != axis] + [axis]
        turned = Transpose(grid, order).call(input=grid)
        done = FFT(turned, axes=(-1,)).call(input=turned)
        grid = Transpose(done, [order.index(k) for k in range(len(order))]).call(input=done)
    return grid
