"""User code over every index of a guiding shape."""

from __future__ import annotations

from collections.abc import Callable

from .. import cplx
from ..meta import Parameter
from ..plans.computation import Computation, Transformation
from ..plans.kernel import Kernel


class PureParallel(Computation):
    """Runs ``code(kernel)`` for each index of the guiding parameter's shape (or a shape)."""

    def __init__(self, parameters: list[Parameter], code: Callable[[Kernel], None], guiding_array: str | tuple[int, ...] | None = None):
        self._root, self._code = parameters, code
        guide = parameters[0].name if guiding_array is None else guiding_array
        if isinstance(guide, str):
            guide = next(p for p in parameters if p.name == guide)
            if not guide.annotation.is_array:
                raise ValueError("The guiding parameter cannot be a scalar")
            guide = guide.meta.shape
        self._shape = tuple(guide)
        super().__init__(parameters)

    @classmethod
    def from_trf(cls, trf: Transformation, guiding_array: str | tuple[int, ...] | None = None) -> PureParallel:
        """The transformation as a computation with the same parameters."""
        return cls(list(trf.parameters.values()), trf.code, guiding_array)

    def _build(self, spark, arrays, scalars):
        columns = {p.name: cplx.constant(scalars[p.name], p.meta.dtype) for p in self._root if not p.annotation.is_array}
        outputs = {p.name: p.meta for p in self._root if p.annotation.is_output}
        return Kernel(spark, self._shape, self._root, arrays, columns).run(self._code, outputs)
