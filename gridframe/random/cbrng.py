"""Arrays of counter-based random numbers.

Samplers that refuse words (gamma, von Mises) give draws and counters in one pass, which is kept
while a ``Shelf`` is open; without one each of the two outputs that is read makes a pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..grid import Grid, coords
from ..meta import ArrayMeta, array, is_complex, real_of, spark_type
from ..plans.computation import Computation, meta_of
from ..plans.shelf import shared
from .catalyst import Words, advanced, generator_key, raw32
from .generators import SAMPLERS, Bijection, Sampler, State, draws, seed_key

COUNTER = "struct<v:array<decimal(20,0)>>"
#: Draws of a generator that are column expressions; more are drawn in numpy.
MAX_DRAWS = 4096
#: Refused draws that are expected of a generator at most. As many words are kept ready for them as leave a chance of 10^-SURE that they do not do, which is an error and no wrong draw.
FEW_REFUSED, SURE = 1e-3, 30
#: Generators of an Arrow batch that are drawn side by side.
LANE = 65_536


class CBRNG(Computation):
    """``randoms`` from ``counters``: a generator for each place on the last axes, draws on the first ones."""

    def __init__(self, randoms_arr, generators_dim: int, sampler: Sampler, seed=None, bijection: Bijection | None = None, reserve_id_space: bool = True):
        meta = meta_of(randoms_arr)
        if sampler.dtype != meta.dtype:
            raise ValueError("The sampler and the array must use the same data type")
        self._meta, self._dim, self._sampler = meta, generators_dim, sampler
        self._bijection = bijection or Bijection("philox", 64, 4)
        self._key = seed_key(self._bijection, seed, reserve_id_space)
        self._counters = ArrayMeta(meta.shape[meta.ndim - generators_dim :], COUNTER)
        super().__init__([array("counters", self._counters.shape, COUNTER, "io"), array("randoms", meta.shape, meta.dtype, "o")])

    def create_counters(self, spark) -> Grid:
        """Counters of all generators, at zero."""
        zero = F.struct(F.array(*[F.lit(0).cast("decimal(20,0)")] * self._bijection.words).alias("v"))
        return Grid.filled(spark, self._counters.shape, COUNTER, zero)

    def _as_columns(self, source, lead: ArrayMeta) -> dict | None:
        """Draws as column expressions, where the bijection and the sampler have them."""
        meta, bijection, plain = self._meta, self._bijection, self._sampler.plain
        n = lead.size
        if bijection.name != "threefry" or plain is None or n > MAX_DRAWS:
            return None
        integer = plain[0] == "integer"
        refused = 1 - plain[3] / (1 << 32) if integer else 0.0
        if n * refused > FEW_REFUSED:
            return None
        spare = math.ceil(SURE / max(0.5, -math.log10(n * refused))) if refused else 0
        parts = 1 if integer or meta.dtype == "float32" else 2  # 32-bit words of a draw
        room = bijection.words * bijection.bitness // 32
        steps = -(-(n * parts + spare) // room)
        w, own = Words(bijection.bitness), coords(self._dim)
        counter = [w.from_decimal(F.get(F.col("v.v"), F.lit(j))) for j in range(bijection.words)]
        number = sum((F.col(c) * s for c, s in zip(own, self._counters.strides)), F.lit(0).cast("bigint"))
        drawn = source.select(*own, F.array(*counter).alias("c"), generator_key(bijection, self._key.tolist(), number).alias("key"))
        counter = [F.get("c", F.lit(j)) for j in range(bijection.words)]
        drawn = drawn.select(*own, "c", raw32(bijection, F.col("key"), counter, steps).alias("raw"))
        if integer:
            _, low, part, limit = plain
            good = F.filter("raw", lambda x: x < F.lit(limit).cast("bigint"))
            values = F.transform(F.slice(good, 1, n), lambda x: (F.call_function("div", x, F.lit(part).cast("bigint")) + low).cast(spark_type(meta.dtype)))
            used = F.aggregate("raw", F.struct(F.lit(0).alias("used"), F.lit(0).alias("got")), lambda s, x: F.when(s["got"] == n, s).otherwise(F.struct((s["used"] + 1).alias("used"), (s["got"] + (x < F.lit(limit).cast("bigint")).cast("int")).alias("got"))), lambda s: s["used"])
            values = F.when(F.size(values) == n, values).otherwise(F.raise_error(F.lit("too many draws were refused")).cast(f"array<{spark_type(meta.dtype)}>"))
        else:
            _, low, high, most = plain
            at = lambda d, j: F.get("raw", d * parts + j)
            first, second = (0, 1) if bijection.bitness == 32 else (1, 0)  # the high word of a pair
            unit = (lambda d: at(d, 0).cast("double") / float(1 << 32)) if parts == 1 else (lambda d: (F.shiftleft(at(d, first), 21) + F.shiftright(at(d, second), 11)).cast("double") / float(1 << 53))
            values = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: F.least(unit(d) * (high - low) + low, F.lit(most)).cast(spark_type(meta.dtype)))
            used = F.lit(n * parts)
        draws_ = drawn.select(*own, F.posexplode(values).alias("d", "v"))
        leading = [F.pmod(F.call_function("div", F.col("d").cast("bigint"), F.lit(s).cast("bigint")), F.lit(size).cast("bigint")) for size, s in zip(lead.shape, lead.strides)]
        names = coords(meta.ndim)
        randoms = draws_.select(*[c.alias(k) for c, k in zip([*leading, *map(F.col, own)], names)], "v")
        after = advanced(bijection, counter, F.call_function("div", used + (room - 1), F.lit(room)))
        counters = drawn.select(*own, F.struct(F.array(*[w.to_decimal(c) for c in after]).alias("v")).alias("v"))
        return {"counters": Grid(counters, self._counters), "randoms": Grid(randoms, meta)}

    def _build(self, spark, arrays, scalars):
        meta, dim, sampler, bijection, key = self._meta, self._dim, self._sampler, self._bijection, self._key
        lead = ArrayMeta(meta.shape[: meta.ndim - dim], "")
        if found := self._as_columns(arrays["counters"].df, lead):
            return found
        n_draws, own = math.prod(lead.shape), coords(dim)
        strides = self._counters.strides
        kind = real_of(meta.dtype)
        is_pair = is_complex(meta.dtype)

        def states(batch):
            index = [batch.column(c).to_numpy() for c in own]
            ids = sum(i * s for i, s in zip(index, strides))
            flat = batch.column("c")
            offsets = flat.offsets.to_numpy()
            words = flat.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy().view(np.uint64).reshape(-1, bijection.words)
            return index, State(bijection, key, np.asarray(ids, np.int64), words)

        def drawn(state, index):
            """Columns of each draw of all generators."""
            for draw, values in draws(state, sampler, n_draws):
                if is_pair:
                    v = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values.real).astype(kind)), pa.array(np.ascontiguousarray(values.imag).astype(kind))], names=["re", "im"])
                elif kind.startswith("uint64"):
                    v = pa.array([int(x) for x in values], pa.decimal128(20, 0))
                else:
                    v = pa.array(values.astype("int64" if kind == "uint32" else kind))
                leading = [pa.array(np.full(len(values), draw // s % size)) for size, s in zip(lead.shape, lead.strides)]
                yield [*leading, *map(pa.array, index), v]

        def next_words(state):
            words = state.next_counters().astype(np.uint64).view(np.int64)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, bijection.words), pa.int32()), pa.array(words.ravel()))

        def lanes(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, LANE):
                    yield states(whole.slice(at, LANE))

        def run(batches):
            for index, state in lanes(batches):
                for columns in drawn(state, index):
                    yield pa.RecordBatch.from_arrays(columns, names=[*coords(meta.ndim), "v"])

        def advance(batches):
            for index, state in lanes(batches):
                state.skip(steps)
                yield pa.RecordBatch.from_arrays([*map(pa.array, index), next_words(state)], names=[*own, "c"])

        def both(batches):
            """Draws, then counters, whose rows have no draw."""
            names = [*coords(meta.ndim), "v", "c"]
            for index, state in lanes(batches):
                n, kinds = len(index[0]), None
                for columns in drawn(state, index):
                    kinds = [c.type for c in columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(pa.int64()))], names=names)
                if kinds:
                    empty = [pa.nulls(n, t) for t in kinds[: len(lead.shape)]]
                    yield pa.RecordBatch.from_arrays([*empty, *map(pa.array, index), pa.nulls(n, kinds[-1]), next_words(state)], names=names)

        fields = lambda names, *more: ", ".join([*(f"{c} bigint" for c in names), *more])
        w, value, counter = Words(bijection.bitness), f"v {spark_type(meta.dtype)}", "c array<bigint>"
        source = arrays["counters"].df.select(*own, F.transform("v.v", w.from_decimal).alias("c"))
        after = F.struct(F.transform("c", w.to_decimal).alias("v")).alias("v")
        places = coords(meta.ndim)
        if sampler.deterministic:
            steps = counter_steps(bijection, sampler, n_draws)
            randoms = source.mapInArrow(run, fields(places, value))
            counters = source.mapInArrow(advance, fields(own, counter)).select(*own, after)
        else:  # how many words a draw takes is known only by drawing, so one pass gives both
            made = shared(source.mapInArrow(both, fields(places, value, counter)))
            randoms = made.where(F.col("c").isNull()).select(*places, "v")
            last = [F.col(p).alias(c) for p, c in zip(places[len(lead.shape) :], own)]
            counters = made.where(F.col("c").isNotNull()).select(*last, after)
        return {"counters": Grid(counters, self._counters), "randoms": Grid(randoms, meta)}


def counter_steps(bijection: Bijection, sampler: Sampler, n_draws: int) -> int:
    """Counters that so many draws of one generator use, if it is the same for all."""
    calls = -(-n_draws // sampler.per_call)
    one = State(bijection, np.zeros(bijection.key_words, bijection.kind), np.zeros(1, np.int64), np.zeros((1, bijection.words), np.uint64))
    few = min(calls, bijection.words * one.halves)  # after so many calls the words start anew
    for _ in draws(one, sampler, few * sampler.per_call):
        pass
    if few == calls:
        return int(one.next_counters()[0, -1])
    period = int(one.next_counters()[0, -1])
    rest = State(bijection, np.zeros(bijection.key_words, bijection.kind), np.zeros(1, np.int64), np.zeros((1, bijection.words), np.uint64))
    for _ in draws(rest, sampler, (calls % few) * sampler.per_call):
        pass
    return period * (calls // few) + int(rest.next_counters()[0, -1])


def _shortcut(name):
    def build(cls, randoms_arr, generators_dim, sampler_kwds=None, seed=None):
        meta = meta_of(randoms_arr)
        return cls(meta, generators_dim, SAMPLERS[name](meta.dtype, **(sampler_kwds or {})), seed)

    build.__doc__ = f"Generator of {name} values with philox of four 64-bit words."
    return classmethod(build)


for _name in SAMPLERS:
    setattr(CBRNG, _name, _shortcut(_name))
