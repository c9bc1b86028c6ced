"""Stock transformations: copy, cast, arithmetic, complex parts, norms, constants."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import cplx
from ..meta import COMPLEX_OF, array, real_of, scalar, spark_type
from ..plans.computation import Transformation, meta_of


def _unary(meta, out_dtype, formula):
    meta = meta_of(meta)

    def code(k):
        k.output.store_same(formula(k.input.load_same()))

    return Transformation([array("output", meta.shape, out_dtype, "o"), array("input", meta.shape, meta.dtype)], code)


def _with_param(meta, name, dtype, out_dtype, formula):
    meta = meta_of(meta)

    def code(k):
        k.output.store_same(formula(k.input.load_same(), getattr(k, name)))

    return Transformation([array("output", meta.shape, out_dtype, "o"), array("input", meta.shape, meta.dtype), scalar(name, dtype)], code)


def _kind(value):
    return "complex128" if isinstance(value, complex) else "float64" if isinstance(value, float) else "int64"


def copy(meta, out=None):
    """output = input; both have one shape and kind."""
    meta = meta_of(meta)
    if out is not None and meta_of(out) != meta:
        raise ValueError("Input and output arrays must have the same shape and data type")
    return _unary(meta, meta.dtype, lambda v: v)


def copy_broadcasted(meta, out):
    """output = input stretched over axes of size 1; connects by ``output`` only."""
    meta, out = meta_of(meta), meta_of(out)
    padded = (1,) * (out.ndim - meta.ndim) + meta.shape
    if meta.dtype != out.dtype or len(padded) != out.ndim or any(a not in (1, b) for a, b in zip(padded, out.shape)):
        raise ValueError("Input is not broadcastable to output")

    def code(k):
        own = k.idxs[out.ndim - meta.ndim :]
        k.output.store_same(k.input.load_idx(*[F.lit(0) if n == 1 else i for n, i in zip(meta.shape, own)]))

    return Transformation([array("output", out.shape, out.dtype, "o"), array("input", meta.shape, meta.dtype)], code, connectors=["output"])


def cast(meta, dtype):
    """Change of kind; floats lose their fraction towards zero."""
    meta = meta_of(meta)
    return _unary(meta, dtype, lambda v: cplx.cast(v, meta.dtype, dtype))


def add_const(meta, value):
    meta = meta_of(meta)
    return _unary(meta, meta.dtype, lambda v: cplx.add(v, meta.dtype, cplx.constant(value, _kind(value)), _kind(value), meta.dtype))


def add_param(meta, dtype):
    meta = meta_of(meta)
    return _with_param(meta, "param", dtype, meta.dtype, lambda v, p: cplx.add(v, meta.dtype, p, dtype, meta.dtype))


def mul_const(meta, value):
    meta = meta_of(meta)
    return _unary(meta, meta.dtype, lambda v: cplx.mul(v, meta.dtype, cplx.constant(value, _kind(value)), _kind(value), meta.dtype))


def mul_param(meta, dtype):
    meta = meta_of(meta)
    return _with_param(meta, "param", dtype, meta.dtype, lambda v, p: cplx.mul(v, meta.dtype, p, dtype, meta.dtype))


def div_const(meta, value):
    meta = meta_of(meta)
    return _unary(meta, meta.dtype, lambda v: cplx.div(v, meta.dtype, cplx.constant(value, _kind(value)), _kind(value), meta.dtype))


def div_param(meta, dtype):
    meta = meta_of(meta)
    return _with_param(meta, "param", dtype, meta.dtype, lambda v, p: cplx.div(v, meta.dtype, p, dtype, meta.dtype))


def split_complex(meta):
    """One complex input, outputs real and imag."""
    meta = meta_of(meta)
    part = real_of(meta.dtype)

    def code(k):
        v = k.input.load_same()
        k.real.store_same(v["re"])
        k.imag.store_same(v["im"])

    return Transformation([array("real", meta.shape, part, "o"), array("imag", meta.shape, part, "o"), array("input", meta.shape, meta.dtype)], code)


def combine_complex(meta):
    """Inputs real and imag, one complex output."""
    meta = meta_of(meta)
    part = real_of(meta.dtype)

    def code(k):
        k.output.store_same(cplx.make(k.real.load_same(), k.imag.load_same(), meta.dtype))

    return Transformation([array("output", meta.shape, meta.dtype, "o"), array("real", meta.shape, part), array("imag", meta.shape, part)], code)


def _norm(v, dtype, order):
    return F.pow(cplx.squared(v, dtype), order / 2).cast(spark_type(real_of(dtype)))


def norm_const(meta, order):
    """abs(input) ** order, real; whole kinds are computed as doubles."""
    meta = meta_of(meta)
    return _unary(meta, real_of(meta.dtype), lambda v: _norm(v, meta.dtype, F.lit(float(order))))


def norm_param(meta):
    """abs(input) ** order with the order given at the call."""
    meta = meta_of(meta)
    return _with_param(meta, "order", "float64", real_of(meta.dtype), lambda v, p: _norm(v, meta.dtype, p))


def ignore(meta):
    """Swallow an output; its columns are pruned."""
    meta = meta_of(meta)
    return Transformation([array("input", meta.shape, meta.dtype)], lambda k: None)


def broadcast_const(meta, value):
    """Every element is ``value``."""
    meta = meta_of(meta)
    return Transformation([array("output", meta.shape, meta.dtype, "o")], lambda k: k.output.store_same(cplx.constant(value, meta.dtype)))


def broadcast_param(meta):
    """Every element is a value given at the call."""
    meta = meta_of(meta)
    return Transformation([array("output", meta.shape, meta.dtype, "o"), scalar("param", meta.dtype)], lambda k: k.output.store_same(k.param))


def to_complex(meta):
    """A real input with imaginary part zero."""
    meta = meta_of(meta)
    return _unary(meta, COMPLEX_OF[meta.dtype], lambda v: cplx.make(v, F.lit(0.0), COMPLEX_OF[meta.dtype]))


def shift_output(meta, axes=None):
    """FFT shift as a transformation of an output: stores under shifted indices."""
    from ..operators.rearrange import shifted

    meta = meta_of(meta)

    def code(k):
        k.output.store_idx(*shifted(k.idxs, meta.shape, axes, 1), k.input.load_same())

    return Transformation([array("output", meta.shape, meta.dtype, "o"), array("input", meta.shape, meta.dtype)], code, connectors=["input"])


