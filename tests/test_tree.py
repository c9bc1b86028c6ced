"""Connection rules, signatures and errors."""

import numpy as np
import pytest

from gridframe.functions import transforms as T
from gridframe.grid import Grid
from gridframe.meta import Annotation, ArrayMeta, Parameter, array, scalar
from gridframe.operators.fold import Reduce, sum_of
from gridframe.operators.pure import PureParallel
from gridframe.plans.computation import Computation, Transformation

META = ArrayMeta((4,), "int64")


def names(op):
    return [p.name for p in op.signature]


def reduce():
    return Reduce(META, sum_of("int64"))


def test_leaf_order():
    op = reduce()
    op.connect("input", T.mul_param(META, "int64"), "output", x="input", coeff="param")
    assert names(op) == ["output", "x", "coeff"]
    op.connect("output", T.add_param(op.parameter.output.meta, "int64"), "input", y="output", more="param")
    assert names(op) == ["y", "more", "x", "coeff"]


def test_values(spark):
    op = reduce()
    op.parameter.input.connect(T.mul_param(META, "int64"), "output", x="input", coeff="param")
    out = op.bind(x=Grid.from_numpy(spark, np.arange(4)), coeff=5)["output"]
    assert out.to_numpy().tolist() == [30]


def test_same_argument_twice(spark):
    op = PureParallel.from_trf(T.combine_complex(ArrayMeta((4,), "complex128")))
    meta = ArrayMeta((4,), "float64")
    op.connect("real", T.copy(meta), "output", x="input")
    op.connect("imag", T.copy(meta), "output", x="input")
    assert names(op) == ["output", "x"]
    assert op.call(x=Grid.from_numpy(spark, np.arange(4.0))).to_numpy().tolist() == [0, 1 + 1j, 2 + 2j, 3 + 3j]


def test_objects_for_names():
    op, trf = reduce(), T.mul_param(META, "int64")
    op.connect(op.parameter.input, trf, trf.output, x=trf.input, c=trf.param)
    assert names(op) == ["output", "x", "c"]
    with pytest.raises(ValueError, match="belong to this computation"):
        reduce().connect(op.parameter.x, trf, trf.output, y=trf.input)
    with pytest.raises(ValueError, match="provided transformation"):
        reduce().connect("input", T.copy(META), trf.output, y=trf.input)


@pytest.mark.parametrize(
    ("call", "message"),
    [
        (lambda op: op.connect("input", T.copy(META), "output", _x="input"), "underscore"),
        (lambda op: op.connect("input", T.copy(META), "output", input="input"), "both as the main connector"),
        (lambda op: op.connect("input", T.mul_param(META, "int64"), "output", x="input"), "do not fully coincide"),
        (lambda op: op.connect("nothing", T.copy(META), "output", x="input"), "not a part of the signature"),
        (lambda op: op.connect("input", T.copy(ArrayMeta((5,), "int64")), "output", x="input"), "Incompatible types"),
        (lambda op: op.connect("output", T.copy(ArrayMeta((1,), "int64")), "output", x="input"), "not available"),
        (lambda op: op.connect("input", T.copy(META), "output", x="input").connect("input", T.copy(META), "output", y="input"), "hidden"),
    ],
)
def test_errors(call, message):
    with pytest.raises(ValueError, match=message):
        call(reduce())


def test_parameters():
    with pytest.raises(ValueError, match="Invalid role"):
        Annotation(META, "x")
    with pytest.raises(ValueError, match="scalar role"):
        Annotation(META, "s")
    with pytest.raises(ValueError, match="input or output role"):
        Annotation(ArrayMeta((), "int64"), "i")
    with pytest.raises(ValueError, match="default"):
        Parameter("a", Annotation(META, "i"), 3)
    with pytest.raises(ValueError, match="'io'"):
        Transformation([array("a", (4,), "int64", "io")], lambda k: None)
    assert Annotation(META).role == "io" and Annotation(META, constant=True).role == "i" and scalar("s", "int64").annotation.role == "s"


def test_bind_checks(spark):
    op = reduce()
    with pytest.raises(TypeError, match="missing"):
        op.bind()
    with pytest.raises(TypeError, match="expected"):
        op.bind(input=3)
    with pytest.raises(TypeError, match="expected"):
        op.bind(input=Grid.from_numpy(spark, np.arange(5)))
    assert op.compile()(input=Grid.from_numpy(spark, np.arange(4).reshape(1, 4))).to_numpy().tolist() == [6]


def test_inplace_and_nested(spark):
    class Twice(Computation):
        """Sum over the array, added to itself."""

        def __init__(self):
            super().__init__([array("output", (1,), "int64", "o"), array("input", (4,), "int64")])

        def _build(self, spark, arrays, scalars):
            inner = reduce()
            inner.connect("output", T.mul_const(ArrayMeta((1,), "int64"), 2), "input", out="output")
            return {"output": inner.bind(input=arrays["input"])["out"]}

    op = Twice()
    op.connect("input", T.add_const(META, 1), "output", x="input")
    assert op.call(x=Grid.from_numpy(spark, np.arange(4))).to_numpy().tolist() == [20]


def test_ignore(spark):
    meta = ArrayMeta((2,), "complex128")
    op = PureParallel.from_trf(T.split_complex(meta), "input")
    op.connect("imag", T.ignore(ArrayMeta((2,), "float64")), "input")
    assert names(op) == ["real", "input"]
    assert list(op.bind(input=Grid.from_numpy(spark, np.array([1 + 2j, 3])))) == ["real"]
