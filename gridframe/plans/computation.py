"""Computations, transformations attached to their parameters, and nesting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from .. import cplx
from ..grid import Grid
from ..meta import Annotation, ArrayMeta, Parameter, Signature
from .kernel import Kernel


class Transformation:
    """Elementwise code with typed parameters, to be attached or run by itself."""

    def __init__(self, parameters: list[Parameter], code: Callable[[Kernel], None], connectors: list[str] | None = None):
        if any(p.annotation.role == "io" for p in parameters):
            raise ValueError("Transformation cannot have 'io' parameters")
        self.parameters = {p.name: p for p in parameters}
        self.code = code
        self.connectors = set(connectors) if connectors is not None else {p.name for p in parameters if p.annotation.is_array}
        for p in parameters:
            setattr(self, p.name, TransformationParameter(self, p.name))


class TransformationParameter:
    """A parameter of a transformation as an object."""

    def __init__(self, trf: Transformation, name: str):
        self.trf, self.name = trf, name


class ComputationParameter:
    """A parameter of a computation as an object; it can be passed for its name."""

    def __init__(self, computation: Computation, parameter: Parameter):
        self.computation, self.name, self.meta, self.annotation = computation, parameter.name, parameter.meta, parameter.annotation

    def connect(self, trf: Transformation, connector: object, **names: object) -> Computation:
        return self.computation.connect(self, trf, connector, **names)


class Edge:
    """A transformation on one side of a node; ``names`` maps its parameters to nodes."""

    def __init__(self, trf: Transformation, connector: str, names: dict[str, str]):
        self.trf, self.connector, self.names = trf, connector, names


class Tree:
    """Root parameters, the transformations on them, and the leaves that a user sees."""

    def __init__(self, roots: list[Parameter]):
        self.roots = [p.name for p in roots]
        self.parameters = {p.name: p for p in roots}
        self.before: dict[str, Edge] = {}  # what makes a node's loaded value
        self.after: dict[str, Edge] = {}  # what takes a node's stored value

    def open_input(self, name: str) -> bool:
        return self.parameters[name].annotation.is_input and name not in self.before

    def open_output(self, name: str) -> bool:
        return self.parameters[name].annotation.is_output and name not in self.after

    def is_leaf(self, name: str) -> bool:
        return not self.parameters[name].annotation.is_array or self.open_input(name) or self.open_output(name)

    def leaves(self) -> list[Parameter]:
        """Depth first; output children, the node if still open, then input children."""
        out: dict[str, Parameter] = {}

        def visit(name: str) -> None:
            after, before = self.after.get(name), self.before.get(name)
            for edge in (after,) if after else ():
                for child in edge.names.values():
                    if child != name:
                        visit(child)
            if self.is_leaf(name) and name not in out:
                p = self.parameters[name]
                role = p.annotation.role
                if role == "io":
                    role = "io" if self.open_input(name) and self.open_output(name) else "i" if self.open_input(name) else "o"
                out[name] = Parameter(name, Annotation(p.meta, role, p.annotation.constant), p.default)
            for edge in (before,) if before else ():
                for child in edge.names.values():
                    if child != name:
                        visit(child)

        for root in self.roots:
            visit(root)
        return list(out.values())

    def connect(self, target: str, trf: Transformation, connector: str, names: dict[str, str]) -> None:
        if target not in self.parameters:
            raise ValueError(f"Parameter '{target}' is not a part of the signature")
        if target not in {p.name for p in self.leaves()}:
            raise ValueError(f"Parameter '{target}' is hidden by transformations")
        if connector not in trf.connectors:
            raise ValueError(f"Parameter '{connector}' is not a connector of the transformation")
        if {connector, *names} != set(trf.parameters) or connector in names:
            raise ValueError("Supplied transformation names do not fully coincide with the existing ones")
        own = trf.parameters[connector]
        if own.meta != self.parameters[target].meta:
            raise ValueError(f"Incompatible types of the transformation parameter '{connector}' and the node '{target}'")
        is_output = own.annotation.is_input
        if not (self.open_output(target) if is_output else self.open_input(target)):
            raise ValueError(f"'{target}' is not available for {'output' if is_output else 'input'} connection")
        for mine, node in names.items():
            p = trf.parameters[mine]
            if node in self.parameters:
                old = self.parameters[node]
                if node not in {x.name for x in self.leaves()}:
                    raise ValueError(f"Parameter '{node}' is hidden by transformations")
                if old.meta != p.meta:
                    raise ValueError(f"Incompatible types of the transformation parameter '{mine}' and the node '{node}'")
                if p.annotation.is_output and old.annotation.is_output and node != target:
                    raise ValueError(f"Cannot connect transformation parameter '{mine}' to an existing output node '{node}'")
        for mine, node in names.items():
            p = trf.parameters[mine]
            if node not in self.parameters:
                self.parameters[node] = p.renamed(node)
            elif self.parameters[node].annotation.role != p.annotation.role and p.annotation.is_array:
                old = self.parameters[node]
                self.parameters[node] = Parameter(node, Annotation(old.meta, "io"))
        (self.after if is_output else self.before)[target] = Edge(trf, connector, dict(names))

    # ------------------------------------------------------------ running

    def run(self, spark: SparkSession, given: dict[str, object], build: Callable[[dict[str, Grid], dict[str, object]], dict[str, Grid]]) -> dict[str, Grid]:
        made: dict[str, Grid] = {}

        def value(name: str) -> object:
            if name not in self.before:
                return given[name]
            if name not in made:
                edge = self.before[name]
                made[name] = self.apply(spark, edge, value, self.parameters[name].meta.shape)[edge.connector]
            return made[name]

        roots = [self.parameters[r] for r in self.roots]
        arrays = {p.name: value(p.name) for p in roots if p.annotation.is_input}
        scalars = {p.name: value(p.name) for p in roots if not p.annotation.is_array}
        results = build(arrays, scalars)
        final: dict[str, Grid] = {}
        waiting = list(results.items())
        while waiting:
            name, grid = waiting.pop(0)
            if name not in self.after:
                final[name] = grid
                continue
            edge = self.after[name]
            waiting += [(edge.names[mine], g) for mine, g in self.apply(spark, edge, value, self.parameters[name].meta.shape, {edge.connector: grid}).items()]
        return final

    @staticmethod
    def apply(spark: SparkSession, edge: Edge, value: Callable[[str], object], shape: tuple[int, ...], fixed: dict[str, Grid] | None = None) -> dict[str, Grid]:
        grids, scalars = dict(fixed or {}), {}
        for mine, p in edge.trf.parameters.items():
            if mine in grids or mine == edge.connector or p.annotation.is_output:
                continue
            got = value(edge.names[mine])
            if p.annotation.is_array:
                grids[mine] = got
            else:
                scalars[mine] = cplx.constant(got, p.meta.dtype)
        parameters = list(edge.trf.parameters.values())
        outputs = {p.name: p.meta for p in parameters if p.annotation.is_output}
        return Kernel(spark, shape, parameters, grids, scalars).run(edge.trf.code, outputs)


class Computation:
    """A typed function of arrays; subclasses give parameters and ``_build``."""

    def __init__(self, parameters: list[Parameter]):
        self._tree = Tree(parameters)
        self._update()

    def _update(self) -> None:
        self.signature = Signature(self._tree.leaves())
        self.parameter = type("Parameters", (), {p.name: ComputationParameter(self, p) for p in self.signature})()

    def _build(self, spark: SparkSession, arrays: dict[str, Grid], scalars: dict[str, object]) -> dict[str, Grid]:
        raise NotImplementedError

    def _name(self, target: object) -> str:
        if isinstance(target, ComputationParameter):
            if target.computation is not self:
                raise ValueError("The connection target must belong to this computation.")
            return target.name
        return str(target)

    def connect(self, target: object, trf: Transformation, connector: object, **names: object) -> Computation:
        """Attach ``trf``: its ``connector`` meets ``target``; ``new=parameter`` names the others."""
        name = self._name(target)

        def own(p: object) -> str:
            if isinstance(p, TransformationParameter):
                if p.trf is not trf:
                    raise ValueError("The transformation parameter must belong to the provided transformation")
                return p.name
            return str(p)

        if name in names:
            raise ValueError(f"'{name}' cannot be supplied both as the main connector and one of the child connections")
        if any(n.startswith("_") for n in names):
            raise ValueError("External parameter name cannot start with the underscore.")
        self._tree.connect(name, trf, own(connector), {own(p): n for n, p in names.items()})
        self._update()
        return self

    def bind(self, *args: object, **named: object) -> dict[str, Grid]:
        """Outputs by name, lazily; arrays are Grids, scalars Python values."""
        given = self.signature.bind(*args, **named)
        spark = None
        for p in self.signature:
            if p.name in given and p.annotation.is_array and p.annotation.is_input:
                grid = given[p.name]
                if not isinstance(grid, Grid):
                    raise TypeError(f"Got {type(grid).__name__} for '{p.name}', expected an array")
                if not p.meta.accepts(grid.meta):
                    raise TypeError(f"Got {grid.meta} for '{p.name}', expected {p.meta}")
                if grid.meta.shape != p.meta.shape:
                    given[p.name] = grid.reshape(p.meta.shape)
                spark = spark or grid.df.sparkSession
        spark = spark or SparkSession.getActiveSession()
        return self._tree.run(spark, given, lambda arrays, scalars: self._build(spark, arrays, scalars))

    def compile(self) -> Callable[..., Grid | dict[str, Grid]]:
        """A callable with the leaf signature; one output comes by itself."""

        def run(*args: object, **named: object) -> Grid | dict[str, Grid]:
            out = self.bind(*args, **named)
            return next(iter(out.values())) if len(out) == 1 else out

        return run

    def call(self, **named: object) -> Grid:
        """The only output."""
        (out,) = self.bind(**named).values()
        return out


def literal(value: object, dtype: str) -> Column:
    return value if isinstance(value, Column) else cplx.constant(value, dtype)


def meta_of(value: Grid | ArrayMeta) -> ArrayMeta:
    return value.meta if isinstance(value, Grid) else value

