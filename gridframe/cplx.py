"""Column expressions over real and complex (struct) values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .meta import is_complex, real_of, spark_type


def make(re: Column, im: Column, dtype: str) -> Column:
    part = spark_type(real_of(dtype))
    return F.struct(re.cast(part).alias("re"), im.cast(part).alias("im"))


def constant(value: object, dtype: str) -> Column:
    """A scalar (also a struct given as a dict) of a kind."""
    if is_complex(dtype):
        z = complex(value)
        return make(F.lit(z.real), F.lit(z.imag), dtype)
    if isinstance(value, dict):
        return F.struct(*[constant(v, dtype="").alias(k) for k, v in value.items()]).cast(dtype) if dtype else F.struct(*[constant(v, "").alias(k) for k, v in value.items()])
    return F.lit(value).cast(spark_type(dtype)) if dtype else F.lit(value)


def widen(v: Column, dtype: str) -> tuple[Column, Column]:
    """(re, im) as doubles."""
    return (v["re"].cast("double"), v["im"].cast("double")) if is_complex(dtype) else (v.cast("double"), F.lit(0.0))


def add(a: Column, ta: str, b: Column, tb: str, out: str) -> Column:
    if not is_complex(out):
        return (a + b).cast(spark_type(out))
    (ar, ai), (br, bi) = widen(a, ta), widen(b, tb)
    return make(ar + br, ai + bi, out)


def mul(a: Column, ta: str, b: Column, tb: str, out: str) -> Column:
    if not is_complex(out):
        return (a * b).cast(spark_type(out))
    (ar, ai), (br, bi) = widen(a, ta), widen(b, tb)
    return make(ar * br - ai * bi, ar * bi + ai * br, out)


def div(a: Column, ta: str, b: Column, tb: str, out: str) -> Column:
    if not is_complex(out):
        return (a / b).cast(spark_type(out))
    (ar, ai), (br, bi) = widen(a, ta), widen(b, tb)
    size = br * br + bi * bi
    return make((ar * br + ai * bi) / size, (ai * br - ar * bi) / size, out)


def squared(v: Column, dtype: str) -> Column:
    """Squared modulus as a double."""
    re, im = widen(v, dtype)
    return re * re + im * im if is_complex(dtype) else re * re


def cast(v: Column, old: str, new: str) -> Column:
    if is_complex(new):
        return make(*widen(v, old), new)
    if is_complex(old):
        raise TypeError("a complex value has no real cast")
    return v.cast(spark_type(new))
