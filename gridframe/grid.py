"""Dense arrays as DataFrames: one row an element, coordinates i0, i1, ... and a value v."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .meta import ArrayMeta, is_complex, spark_type


def coords(ndim: int) -> list[str]:
    return [f"i{k}" for k in range(ndim)]


class Grid:
    """A DataFrame of coordinates and value with the array's static description."""

    def __init__(self, df: DataFrame, meta: ArrayMeta):
        self.df, self.meta = df.select(*coords(meta.ndim), "v"), meta

    @staticmethod
    def from_df(df: DataFrame, index: list[Column | str], value: Column | str, shape: tuple[int, ...], dtype: str) -> Grid:
        """Coordinates and value from any columns; nothing is moved."""
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        cols = [as_column(c).cast("bigint").alias(f"i{k}") for k, c in enumerate(index)]
        return Grid(df.select(*cols, as_column(value).cast(spark_type(dtype)).alias("v")), ArrayMeta(tuple(shape), dtype))

    @staticmethod
    def from_numpy(spark: SparkSession, values: np.ndarray, dtype: str | None = None) -> Grid:
        """A small array from the driver."""
        values = np.asarray(values)
        dtype = dtype or str(values.dtype)
        index = np.indices(values.shape).reshape(values.ndim, -1)
        flat = values.ravel().tolist()
        rows = [(*map(int, at), (v.real, v.imag) if is_complex(dtype) else v) for at, v in zip(index.T, flat)]
        fields = ", ".join([*(f"{c} bigint" for c in coords(values.ndim)), f"v {spark_type(dtype)}"])
        return Grid(spark.createDataFrame(rows, fields), ArrayMeta(values.shape, dtype))

    @staticmethod
    def filled(spark: SparkSession, shape: tuple[int, ...], dtype: str, value: Column) -> Grid:
        """An array of one expression, which may use the coordinates."""
        meta = ArrayMeta(tuple(shape), dtype)
        return Grid(unravel(spark.range(meta.size), F.col("id"), meta.shape).withColumn("v", value.cast(spark_type(dtype))), meta)

    def to_numpy(self) -> np.ndarray:
        """The whole array on the driver; for small results."""
        rows = self.df.collect()
        kind = self.meta.dtype if self.meta.dtype in np.sctypeDict else object
        out = np.zeros(self.meta.shape, dtype=kind)
        for row in rows:
            v = row["v"]
            out[tuple(row[c] for c in coords(self.meta.ndim))] = complex(v["re"], v["im"]) if is_complex(self.meta.dtype) else v
        return out

    def with_value(self, value: Column, dtype: str) -> Grid:
        return Grid(self.df.select(*coords(self.meta.ndim), value.alias("v")), self.meta.with_dtype(dtype))

    def with_coords(self, index: list[Column], shape: tuple[int, ...]) -> Grid:
        """The same values under other coordinates: a projection."""
        return Grid(self.df.select(*[c.cast("bigint").alias(f"i{k}") for k, c in enumerate(index)], "v"), ArrayMeta(tuple(shape), self.meta.dtype))

    def reshape(self, shape: tuple[int, ...]) -> Grid:
        """Row-major reshape: a projection."""
        if math.prod(shape) != self.meta.size:
            raise ValueError(f"cannot reshape {self.meta.shape} into {shape}")
        flat = sum((F.col(c) * s for c, s in zip(coords(self.meta.ndim), self.meta.strides)), F.lit(0).cast("bigint"))
        return Grid(unravel(self.df.withColumn("__flat", flat).select("__flat", "v"), F.col("__flat"), shape, "v"), ArrayMeta(tuple(shape), self.meta.dtype))

    def check_dense(self) -> None:
        """Raise unless every coordinate has exactly one non-null value."""
        own = [F.col(c) for c in coords(self.meta.ndim)]
        inside = F.lit(True)
        for c, n in zip(own, self.meta.shape):
            inside = inside & (c >= 0) & (c < n)
        found = self.df.agg(F.count("v").alias("n"), F.count_if(~inside).alias("out")).first()
        if found["n"] != self.meta.size or found["out"]:
            raise ValueError(f"the array is not dense: {found['n']} values for shape {self.meta.shape}, {found['out']} outside")
        if own and not self.df.groupBy(*own).count().where("count > 1").isEmpty():
            raise ValueError("a coordinate occurs more than once")


def unravel(df: DataFrame, flat: Column, shape: tuple[int, ...], *keep: str) -> DataFrame:
    """Coordinates of a row-major position."""
    meta = ArrayMeta(tuple(shape), "")
    index = [F.pmod(F.call_function("div", flat, F.lit(s).cast("bigint")), F.lit(n).cast("bigint")) if n > 1 else F.lit(0) for n, s in zip(meta.shape, meta.strides)]
    return df.select(*[c.cast("bigint").alias(f"i{k}") for k, c in enumerate(index)], *keep)
