"""Static description of arrays and of the parameters of a computation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

#: Scalar kinds and their Spark types; complex values are structs (re, im).
SPARK_TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>",
}
REAL_OF = {"complex64": "float32", "complex128": "float64"}
COMPLEX_OF = {"float32": "complex64", "float64": "complex128"}


def spark_type(dtype: str) -> str:
    """Spark type of a kind; anything else is a Spark type already (structs, arrays)."""
    return SPARK_TYPES.get(dtype, dtype)


def is_complex(dtype: str) -> bool:
    return dtype in REAL_OF


def real_of(dtype: str) -> str:
    return REAL_OF.get(dtype, dtype)


def normalize_axes(ndim: int, axes: int | tuple[int, ...] | None) -> tuple[int, ...]:
    """Non-negative distinct axes; None is all of them."""
    if axes is None:
        return tuple(range(ndim))
    found = tuple(a + ndim if a < 0 else a for a in ((axes,) if isinstance(axes, int) else axes))
    if any(not 0 <= a < ndim for a in found):
        raise ValueError("Axes numbers are out of bounds")
    if len(set(found)) != len(found):
        raise ValueError("Cannot use the same axis twice")
    return found


@dataclass(frozen=True)
class ArrayMeta:
    """Shape and value kind of a dense array; shape () is a scalar."""

    shape: tuple[int, ...]
    dtype: str

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(math.prod(self.shape[k + 1 :]) for k in range(self.ndim))

    def with_dtype(self, dtype: str) -> ArrayMeta:
        return replace(self, dtype=dtype)

    def accepts(self, other: ArrayMeta) -> bool:
        """Same kind and trailing sizes; what else leads has size 1."""
        longer, shorter = (self.shape, other.shape) if self.ndim >= other.ndim else (other.shape, self.shape)
        cut = len(longer) - len(shorter)
        return self.dtype == other.dtype and longer[cut:] == shorter and math.prod(longer[:cut]) == 1


@dataclass(frozen=True)
class Annotation:
    """A type with its role: i, o, io or s, and whether it is a constant array."""

    meta: ArrayMeta
    role: str = ""
    constant: bool = False

    def __post_init__(self) -> None:
        scalar = self.meta.shape == ()
        role = self.role or ("s" if scalar else "i" if self.constant else "io")
        object.__setattr__(self, "role", role)
        if role not in ("i", "o", "io", "s"):
            raise ValueError(f"Invalid role: {role}")
        if role == "s" and not scalar:
            raise ValueError("Only scalars can have the scalar role")
        if role != "s" and scalar:
            raise ValueError("Scalars cannot have input or output role")
        if self.constant and role != "i":
            raise ValueError("Constant arrays can only be inputs")

    @property
    def is_input(self) -> bool:
        return "i" in self.role

    @property
    def is_output(self) -> bool:
        return "o" in self.role

    @property
    def is_array(self) -> bool:
        return self.role != "s"


@dataclass(frozen=True)
class Parameter:
    """A named annotation; scalars may have a default."""

    name: str
    annotation: Annotation
    default: object = None

    def __post_init__(self) -> None:
        if self.default is not None and self.annotation.is_array:
            raise ValueError("Array parameters cannot have default values")

    @property
    def meta(self) -> ArrayMeta:
        return self.annotation.meta

    def renamed(self, name: str) -> Parameter:
        return replace(self, name=name)


class Signature:
    """Ordered parameters; binds positional and named arguments."""

    def __init__(self, parameters: list[Parameter]):
        self.parameters = {p.name: p for p in parameters}

    def __iter__(self) -> Iterator[Parameter]:
        return iter(self.parameters.values())

    def __repr__(self) -> str:
        return "(" + ", ".join(f"{p.name}: {p.annotation.role}{list(p.meta.shape)} {p.meta.dtype}" for p in self) + ")"

    def bind(self, *args: object, **named: object) -> dict[str, object]:
        """Arguments by name with defaults; outputs need none."""
        names = list(self.parameters)
        if len(args) > len(names):
            raise TypeError("too many arguments")
        given = dict(zip(names, args))
        if twice := given.keys() & named.keys():
            raise TypeError(f"multiple values for {sorted(twice)}")
        given |= named
        if alien := given.keys() - self.parameters.keys():
            raise TypeError(f"unexpected arguments {sorted(alien)}")
        for p in self:
            if p.name not in given:
                if p.default is not None:
                    given[p.name] = p.default
                elif p.annotation.is_input or not p.annotation.is_array:
                    raise TypeError(f"missing argument '{p.name}'")
        return given


def array(name: str, shape: tuple[int, ...], dtype: str, role: str = "i", constant: bool = False) -> Parameter:
    return Parameter(name, Annotation(ArrayMeta(tuple(shape), dtype), role, constant))


def scalar(name: str, dtype: str, default: object = None) -> Parameter:
    return Parameter(name, Annotation(ArrayMeta((), dtype)), default)
