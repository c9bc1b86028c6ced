"""Queries over the tables for each operator, with the SQL they must agree with.

Arrays are embedded in the tables: ``events`` is a 1-d signal in whole cents,
``embeddings`` a matrix, ``lineitem`` and ``orders`` keyed values.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks
from .functions import transforms as T
from .grid import Grid
from .meta import ArrayMeta, array
from .operators.fold import Difference, Monoid, Reduce, Scan, max_of, min_max, sum_of
from .operators.linear import EntrywiseNorm, MatrixMul
from .operators.pure import PureParallel
from .operators.rearrange import FFTShift, Roll, RollInplace, Transpose
from .operators.spectral import DHT, FFT, dht_matrix
from .random.cbrng import CBRNG
from .random.generators import PARITY, PHILOX_M, PHILOX_W, THREEFRY_ROT, Bijection, seed_key, uniform_integer
from .recipes import signals
from .sources.tables import complex_vectors, length, signal, table, vectors

DIGITS = 4


def rounded(c: str):
    """Rounded without a negative zero."""
    return F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0)


def real(grid: Grid, name: str = "v") -> DataFrame:
    return grid.df.withColumn("v", rounded("v")).withColumnRenamed("v", name)


def complex_rows(grid: Grid) -> DataFrame:
    own = [c for c in grid.df.columns if c != "v"]
    return grid.df.select(*own, rounded("v.re").alias("re"), rounded("v.im").alias("im"))


def events_by_user(spark, d):
    """(user, place among the user's events): cents; absent places are 0."""
    events = table(spark, d, "events")
    return events.select(F.col("user_id").alias("i0"), F.col("event_id").alias("i1"), F.round(F.col("value") * 100).cast("bigint").alias("v"))


def by_user(spark, d):
    events = events_by_user(spark, d)
    return Grid(events, ArrayMeta((length(events, "i0"), length(events, "i1")), "int64"))


def trf(transformation, guide=None, **given):
    return PureParallel.from_trf(transformation, guide).bind(**given)


# ------------------------------------------------------------ queries


def reduce_sum(spark, d):
    """Twice the cents of line items by return flag and status, as a (3, 2) array."""
    items = table(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    status = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    grid = Grid.from_df(items, [flag, status, place], F.round(F.col("l_extendedprice") * 100), (3, 2, length(items.select(place.alias("p")), "p")), "int64")
    op = Reduce(grid, sum_of("int64"), axes=(2,))
    op.connect("input", T.mul_const(grid.meta, 2), "output", items="input")
    return op.call(items=grid).df


def reduce_all(spark, d):
    grid = signal(spark, d)
    return Reduce(grid, sum_of("int64")).call(input=grid).df


def reduce_two_axes(spark, d):
    grid = vectors(spark, d)
    cube = grid.with_value(F.round(F.col("v") * 1000).cast("bigint"), "int64").reshape((grid.meta.shape[0], 8, 8))
    return Reduce(cube, sum_of("int64"), axes=(0, 2)).call(input=cube).df


def reduce_minmax(spark, d):
    """Struct monoid: least and greatest cents by user."""
    grid = by_user(spark, d)
    pair = F.struct(F.col("v").cast("bigint").alias("cur_min"), F.col("v").cast("bigint").alias("cur_max"))
    monoid = min_max(part="bigint")
    pairs = grid.with_value(pair, monoid.dtype)
    out = Reduce(pairs, monoid, axes=(1,)).call(input=pairs)
    return out.df.select("i0", "i1", "v.cur_min", "v.cur_max")


def reduce_monoid(spark, d):
    """A monoid without a Catalyst aggregate: product modulo a prime."""
    grid = signal(spark, d).with_value(F.pmod("v", F.lit(97)) + 1, "int64")
    product = Monoid(lambda a, b: F.pmod(a * b, F.lit(1_000_003).cast("bigint")), 1, "int64")
    return Reduce(grid, product).call(input=grid).df


def scan_by_user(exclusive):
    def run(spark, d):
        grid = by_user(spark, d)
        return Scan(grid, sum_of("int64"), axes=(1,), exclusive=exclusive).call(input=grid).df

    return run


def scan_global(exclusive):
    def run(spark, d):
        grid = signal(spark, d)
        return Scan(grid, sum_of("int64"), exclusive=exclusive, block=1024).call(input=grid).df

    return run


def scan_max(spark, d):
    grid = signal(spark, d)
    return Scan(grid, max_of("int64", -(1 << 62)), block=1024).call(input=grid).df


def scan_generic(spark, d):
    """Structs and an operation without a Catalyst aggregate: prefix sums and prefix maxima of the signal."""
    grid = signal(spark, d)
    dtype = "struct<total:bigint,top:bigint>"
    pair = lambda a, b: F.struct(a.alias("total"), b.alias("top"))
    monoid = Monoid(lambda a, b: pair(a["total"] + b["total"], F.greatest(a["top"], b["top"])), {"total": 0, "top": -(1 << 62)}, dtype)
    pairs = grid.with_value(pair(F.col("v"), F.col("v")), dtype)
    out = Scan(pairs, monoid, block=1024).call(input=pairs)
    return out.df.select("i0", "v.total", "v.top")


def scan_axes(spark, d):
    """Scan over both axes, columns first."""
    grid = vectors(spark, d)
    whole = grid.with_value(F.round(F.col("v") * 1000).cast("bigint"), "int64")
    return Scan(whole, sum_of("int64"), axes=(1, 0), block=4096).call(input=whole).df


def roll(spark, d):
    grid = signal(spark, d)
    return Roll(grid).call(input=grid, shift=-1234).df


def roll_inplace(spark, d):
    grid = vectors(spark, d)
    return real(RollInplace(grid, axis=1).call(array=grid, shift=70))


def fftshift(inverse):
    def run(spark, d):
        grid = vectors(spark, d)
        return real(FFTShift(grid).call(input=grid, inverse=inverse))

    return run


def transpose(spark, d):
    grid = vectors(spark, d)
    return real(Transpose(grid).call(input=grid))


def transpose_axes(spark, d):
    grid = vectors(spark, d)
    cube = grid.reshape((grid.meta.shape[0], 16, 4))
    return real(Transpose(cube, (2, 0, 1)).call(input=cube))


def copy(spark, d):
    grid = signal(spark, d)
    return trf(T.copy(grid.meta), input=grid)["output"].df


def copy_broadcasted(spark, d):
    """One row of nation keys stretched over regions."""
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    row = Grid.from_df(nations, ["n_nationkey"], "n_regionkey", (length(nations, "n_nationkey"),), "int32")
    out = ArrayMeta((length(regions, "r_regionkey"), *row.meta.shape), "int32")
    return trf(T.copy_broadcasted(row.meta, out), "output", input=row)["output"].df


def cast(spark, d):
    events = table(spark, d, "events")
    grid = Grid.from_df(events, ["event_id"], "value", (length(events, "event_id"),), "float64")
    return trf(T.cast(grid.meta, "int32"), input=grid)["output"].df


def arithmetic(spark, d):
    """add, mul and div by constants and by parameters, chained on one input."""
    grid = signal(spark, d)
    op = PureParallel.from_trf(T.add_param(grid.meta, "int64"))
    op.connect("input", T.mul_const(grid.meta, 3), "output", x="input")
    op.connect("output", T.mul_param(grid.meta, "int64"), "input", y="output", factor="param")
    op.connect("y", T.add_const(grid.meta, -7), "input", z="output")
    return op.call(x=grid, param=11, factor=2).df


def division(spark, d):
    events = table(spark, d, "events")
    grid = Grid.from_df(events, ["event_id"], "value", (length(events, "event_id"),), "float64")
    op = PureParallel.from_trf(T.div_const(grid.meta, 4.0))
    op.connect("input", T.div_param(grid.meta, "float64"), "output", x="input", by="param")
    return real(op.call(x=grid, by=0.5))


def split_complex(spark, d):
    """Even and odd places of vectors as one complex array, split again."""
    grid = complex_pairs(spark, d)
    out = trf(T.split_complex(grid.meta), "input", input=grid)
    both = out["real"].df.withColumnRenamed("v", "re").join(out["imag"].df.select(F.col("i0").alias("k0"), F.col("i1").alias("k1"), F.col("v").alias("im")), (F.col("i0") == F.col("k0")) & (F.col("i1") == F.col("k1")))
    return both.select("i0", "i1", rounded("re").alias("re"), rounded("im").alias("im"))


def complex_pairs(spark, d):
    grid = vectors(spark, d)
    n, width = grid.meta.shape
    half = ArrayMeta((n, width // 2), "float64")
    parts = [Grid(grid.df.where(F.pmod("i1", F.lit(2)) == k).select("i0", F.call_function("div", F.col("i1"), F.lit(2).cast("bigint")).alias("i1"), "v"), half) for k in (0, 1)]
    return trf(T.combine_complex(half.with_dtype("complex128")), real=parts[0], imag=parts[1])["output"]


def combine_complex(spark, d):
    return complex_rows(complex_pairs(spark, d))


def norm_const(spark, d):
    grid = complex_pairs(spark, d)
    return real(trf(T.norm_const(grid.meta, 3), input=grid)["output"])


def norm_param(spark, d):
    grid = complex_pairs(spark, d)
    return real(trf(T.norm_param(grid.meta), input=grid, order=0.5)["output"])


def ignore(spark, d):
    """One of two outputs swallowed."""
    grid = complex_pairs(spark, d)
    op = PureParallel.from_trf(T.split_complex(grid.meta), "input")
    op.connect("imag", T.ignore(grid.meta.with_dtype("float64")), "input")
    (out,) = op.bind(input=grid).values()
    return real(out)


def broadcast_value(spark, d):
    """Arrays of a constant and of a parameter, the shape of nations by regions."""
    n, r = (length(table(spark, d, t), c) for t, c in (("nation", "n_nationkey"), ("region", "r_regionkey")))
    meta = ArrayMeta((r, n), "int64")
    fixed = trf(T.broadcast_const(meta, 7))["output"]
    given = trf(T.broadcast_param(meta), param=9)["output"]
    return fixed.df.withColumnRenamed("v", "fixed").join(given.df.withColumnRenamed("v", "given"), ["i0", "i1"])


def pureparallel_gather(spark, d):
    """Each event plus the one mirrored at the end."""
    grid = signal(spark, d)
    (n,) = grid.meta.shape

    def code(k):
        k.output.store_same(k.input.load_same() - k.input.load_affine((n - 1,), (-1,)))

    return PureParallel([array("output", (n,), "int64", "o"), array("input", (n,), "int64")], code).call(input=grid).df


def pureparallel_join(spark, d):
    """Each event plus the one at half its place, which two events load."""
    grid = signal(spark, d)
    (n,) = grid.meta.shape

    def code(k):
        k.output.store_same(k.input.load_same() + k.input.load_idx(F.call_function("div", k.idxs[0], F.lit(2).cast("bigint"))))

    return PureParallel([array("output", (n,), "int64", "o"), array("input", (n,), "int64")], code).call(input=grid).df


def pureparallel_scatter(spark, d):
    """Two stores an index: values and their squares side by side, even values only."""
    grid = signal(spark, d)
    (n,) = grid.meta.shape

    def code(k):
        v = k.input.load_same()
        even = F.pmod(v, F.lit(2)) == 0
        k.output.store_idx(k.idxs[0], F.lit(0), v, where=even)
        k.output.store_idx(k.idxs[0], F.lit(1), v * v, where=even)

    return PureParallel([array("output", (n, 2), "int64", "o"), array("input", (n,), "int64")], code, "input").call(input=grid).df


def lanes_of_vectors(spark, d, dtype="float64"):
    """Vectors as chunks: the table's rows are blocks already."""
    embeddings = table(spark, d, "embeddings")
    width = embeddings.select(F.size("embedding")).first()[0]
    return Chunks.from_lanes(embeddings, ["vec_id"], "embedding", (length(embeddings, "vec_id"), width), dtype)


def chunk_reduce(spark, d):
    """Sums over all vectors, folded in the blocks first."""
    lanes = lanes_of_vectors(spark, d)
    return real(lanes.reduce(sum_of("float64"), axes=(0,)))


def chunk_transpose(spark, d):
    """Blocks of 128 x 16 places, permuted inside and moved as blocks."""
    return real(lanes_of_vectors(spark, d).rechunk((128, 16)).transpose().to_grid())


def chunk_fft(spark, d):
    """Complex vectors, transformed in the blocks that they lie in."""
    lanes = lanes_of_vectors(spark, d)
    pairs = lanes.df.select(*lanes.names, F.transform("v", lambda x: F.struct(x.alias("re"), F.lit(0.0).alias("im"))).alias("v"))
    return complex_rows(Chunks(pairs, lanes.meta.with_dtype("complex128"), lanes.chunk).fft(axis=1).to_grid())


def chunk_matmul(spark, d):
    """E' E from blocks, the places of 128 vectors a tile."""
    lanes = lanes_of_vectors(spark, d)
    return real(lanes.transpose().matmul(lanes, tile=128).to_grid())


def difference(spark, d):
    """What each event adds to the one before; blocks of 512 events meet their borders only."""
    grid = signal(spark, d)
    return Difference(grid, sum_of("int64"), block=512).call(input=grid).df


def matmul_gram(spark, d):
    """Products of all places of the vectors: E' E."""
    grid = vectors(spark, d)
    return real(MatrixMul(grid, grid, transposed_a=True).call(matrix_a=grid, matrix_b=grid))


def matmul_batch(spark, d):
    """Each vector as an 8 x 8 matrix, squared."""
    grid = vectors(spark, d)
    cube = grid.reshape((grid.meta.shape[0], 8, 8))
    return real(MatrixMul(cube, cube).call(matrix_a=cube, matrix_b=cube))


def entrywise_norm(spark, d):
    grid = vectors(spark, d)
    return real(EntrywiseNorm(grid, 2, axes=(1,)).call(input=grid))


def fft_lanes(inverse):
    def run(spark, d):
        grid = complex_vectors(spark, d)
        return complex_rows(FFT(grid, axes=(1,)).call(input=grid, inverse=inverse))

    return run


def fft_four_step(spark, d):
    """The same transform with lanes too long for a task (8 elements here)."""
    grid = complex_vectors(spark, d)
    return complex_rows(FFT(grid, axes=(1,), max_lane=8).call(input=grid))


def fft_real_shifted(spark, d):
    """Real input by a transformation, shifted output by another."""
    grid = vectors(spark, d)
    meta = grid.meta.with_dtype("complex128")
    op = FFT(meta, axes=(1,))
    op.connect("input", T.to_complex(grid.meta), "output", signal="input")
    op.connect("output", T.shift_output(meta, axes=(1,)), "input", spectrum="output")
    return complex_rows(op.bind(signal=grid)["spectrum"])


def fft_chirp(spark, d):
    """Frames of a prime length, longer than a lane of a task (16 elements here)."""
    grid = signals.frames(signal(spark, d), 61, 30)
    turned = trf(T.to_complex(grid.with_value(F.col("v").cast("double"), "float64").meta), input=grid.with_value(F.col("v").cast("double"), "float64"))["output"]
    return complex_rows(FFT(turned, axes=(1,), max_lane=16).call(input=turned))


#: Modes whose second-order transform has 64 points, as many as a vector has places.
DHT_MODES = 43


def dht_forward(spark, d):
    """Modes of each vector, as if sampled on the spatial grid."""
    grid = vectors(spark, d)
    return real(DHT(ArrayMeta((grid.meta.shape[0], DHT_MODES), "float64"), order=2, axes=(1,)).call(coords=grid))


def dht_inverse(spark, d):
    """Values on the spatial grid of the function that has each vector as modes."""
    grid = vectors(spark, d)
    return real(DHT(grid.meta, inverse=True, axes=(1,)).call(modes=grid))


def spectro_frames(spark, d):
    return signals.frames(signal(spark, d), 64, 48).df


def spectrogram(spark, d):
    grid = signal(spark, d)
    return real(signals.spectrogram(grid.with_value(F.col("v").cast("double"), "float64"), 64, 48, 64))


def rfft(spark, d):
    return complex_rows(signals.rfft(vectors(spark, d)))


def irfft_round_trip(spark, d):
    return real(signals.irfft(signals.rfft(vectors(spark, d))))


def aprfft(spark, d):
    return complex_rows(signals.aprfft(vectors(spark, d)))


def iaprfft_round_trip(spark, d):
    return real(signals.iaprfft(signals.aprfft(vectors(spark, d))))


def fftn_by_transposes(spark, d):
    return complex_rows(signals.fftn_by_transposes(complex_vectors(spark, d), (1,)))


def cbrng(name, dtype, **options):
    def run(spark, d):
        n = length(table(spark, d, "events"), "event_id")
        op = getattr(CBRNG, name)(ArrayMeta((4, n), dtype), 1, options, seed=456)
        out = op.bind(counters=op.create_counters(spark))["randoms"]
        if dtype.startswith("complex"):
            return complex_rows(out)
        return out.df if name.startswith("uniform") else real(out)  # logarithms and angles differ in the last bit between libraries

    return run


def cbrng_threefry(spark, d):
    n = length(table(spark, d, "events"), "event_id")
    op = CBRNG(ArrayMeta((4, n), "int32"), 1, uniform_integer("int32", -10, 98), seed=456, bijection=Bijection("threefry", 32, 4))
    return op.bind(counters=op.create_counters(spark))["randoms"].df


QUERIES = {
    "reduce_sum": reduce_sum, "reduce_all": reduce_all, "reduce_two_axes": reduce_two_axes, "reduce_struct_minmax": reduce_minmax, "reduce_generic_monoid": reduce_monoid,
    "scan_inclusive": scan_by_user(False), "scan_exclusive": scan_by_user(True), "scan_global": scan_global(False), "scan_global_exclusive": scan_global(True), "scan_max": scan_max, "scan_axes": scan_axes, "scan_generic": scan_generic,
    "roll": roll, "roll_inplace": roll_inplace, "fftshift": fftshift(0), "fftshift_inverse": fftshift(1), "transpose": transpose, "transpose_axes": transpose_axes,
    "copy": copy, "copy_broadcasted": copy_broadcasted, "cast": cast, "arithmetic": arithmetic, "division": division, "split_complex": split_complex, "combine_complex": combine_complex, "norm_const": norm_const, "norm_param": norm_param, "ignore": ignore, "broadcast_value": broadcast_value,
    "pureparallel_gather": pureparallel_gather, "pureparallel_join": pureparallel_join, "pureparallel_scatter": pureparallel_scatter, "chunk_reduce": chunk_reduce, "chunk_transpose": chunk_transpose, "chunk_fft": chunk_fft, "chunk_matmul": chunk_matmul, "difference": difference, "matmul_gram": matmul_gram, "matmul_batch": matmul_batch, "entrywise_norm": entrywise_norm,
    "fft_lanes": fft_lanes(0), "fft_inverse": fft_lanes(1), "fft_four_step": fft_four_step, "fft_real_shifted": fft_real_shifted, "fft_chirp": fft_chirp, "dht_forward": dht_forward, "dht_inverse": dht_inverse,
    "spectro_frames": spectro_frames, "spectrogram": spectrogram, "rfft": rfft, "irfft_round_trip": irfft_round_trip, "aprfft": aprfft, "iaprfft_round_trip": iaprfft_round_trip, "fftn_by_transposes": fftn_by_transposes,
    "cbrng_uniform_integer": cbrng("uniform_integer", "int32", low=-10, high=98), "cbrng_uniform_float": cbrng("uniform_float", "float64", low=-5.0, high=7.7), "cbrng_normal": cbrng("normal_bm", "float64", mean=-2.0, std=10.0), "cbrng_normal_complex": cbrng("normal_bm", "complex128", mean=-3 + 4j, std=7.0), "cbrng_gamma": cbrng("gamma", "float64", shape=3.0, scale=10.0), "cbrng_vonmises": cbrng("vonmises", "float64", mu=1.0, kappa=0.7), "cbrng_threefry": cbrng_threefry,
}

# ------------------------------------------------------------ SQL

SIGNAL = "s AS (SELECT event_id AS i0, round(value * 100)::bigint AS v FROM events), n AS (SELECT max(i0) + 1 AS n FROM s)"
MATRIX = "e AS (SELECT vec_id AS i0, unnest(range(len(embedding))) AS i1, unnest(embedding)::double AS v FROM embeddings), n AS (SELECT max(i0) + 1 AS n FROM e)"
USERS = "u AS (SELECT user_id AS i0, event_id AS i1, round(value * 100)::bigint AS v FROM events)"
PAIRS = f"{MATRIX}, z AS (SELECT a.i0, a.i1 // 2 AS i1, a.v AS re, b.v AS im FROM e a JOIN e b ON a.i0 = b.i0 AND b.i1 = a.i1 + 1 WHERE a.i1 % 2 = 0)"


def R(x: str) -> str:
    return f"round({x}, {DIGITS}) + 0.0"


def dft(sign: int, scale: str, shift: int = 0, half: bool = False, matrix: str = MATRIX) -> str:
    out = f"(k + {shift}) % 64" if shift else "k"
    return f"""WITH {matrix}, f AS (SELECT unnest(range({33 if half else 64})) AS k)
SELECT i0, {out} AS i1, {R(f'sum(v * cos({sign} * 2 * pi() * ((i1 * k) % 64) / 64)) * {scale}')} AS re, {R(f'sum(v * sin({sign} * 2 * pi() * ((i1 * k) % 64) / 64)) * {scale}')} AS im
FROM e CROSS JOIN f GROUP BY i0, k"""


def dht_sql(modes: int, order: int, inverse: bool) -> str:
    p = dht_matrix(modes, order, 0, inverse)
    rows = ", ".join(f"({j}, {m}, {p[j, m]!r}::double)" for j in range(p.shape[0]) for m in range(p.shape[1])).replace("np.float64(", "(")
    return f"WITH {MATRIX}, p(j, m, w) AS (VALUES {rows}) SELECT i0, m AS i1, {R('sum(v * w)')} AS v FROM e JOIN p ON i1 = j GROUP BY i0, m"


def frames_sql(size: int, step: int) -> str:
    return f"f AS (SELECT k.k AS f, s.i0 - k.k * {step} AS j, s.v FROM n, unnest(range(0, (n.n - {size - step}) // {step})) AS k(k) JOIN s ON s.i0 >= k.k * {step} AND s.i0 < k.k * {step} + {size})"


def philox_sql(ids: str, counter: int | str) -> str:
    """Words x0 .. x3 of each id for a counter (a number or a column): ten rounds of products of 128 bits."""
    m0, m1 = PHILOX_M[64, 4]
    w0, w1 = PHILOX_W[64]
    k0, mask = int(seed_key(Bijection(), 456)[0]), f"{(1 << 64) - 1}::uhugeint"
    sql = f"SELECT *, 0::uhugeint AS x0, 0::uhugeint AS x1, 0::uhugeint AS x2, {counter}::uhugeint AS x3 FROM ({ids})"
    for r in range(10):
        key = f"{(k0 + r * w0) % (1 << 64)}::uhugeint", f"((id + {r * w1 % (1 << 64)}::uhugeint) & {mask})"
        sql = f"SELECT * EXCLUDE (p0, p1) REPLACE (xor(xor(p1 >> 64, x1), {key[0]}) AS x0, p1 & {mask} AS x1, xor(xor(p0 >> 64, x3), {key[1]}) AS x2, p0 & {mask} AS x3) FROM (SELECT *, {m0}::uhugeint * x0 AS p0, {m1}::uhugeint * x2 AS p1 FROM ({sql}))"
    return sql


def threefry_sql(ids: str) -> str:
    """Words x0 .. x3 of 32 bits of each id for counter zero: twenty rounds of sums and turns."""
    key = [int(k) for k in seed_key(Bijection("threefry", 32, 4), 456)[:3]]
    mask = (1 << 32) - 1
    last = PARITY[32] ^ key[0] ^ key[1] ^ key[2]
    ks = [*map(str, key), "id", f"xor({last}, id)"]
    sql = f"SELECT id, {', '.join(f'(({ks[j]}) & {mask}) AS x{j}' for j in range(4))} FROM ({ids})"
    for r in range(20):
        for (a, b), by in zip(((0, 1), (2, 3)) if r % 2 == 0 else ((0, 3), (2, 1)), THREEFRY_ROT[32, 4][r % 8]):
            sql = f"SELECT * REPLACE (xor(((x{b} << {by}) & {mask}) | (x{b} >> {32 - by}), x{a}) AS x{b}) FROM (SELECT * REPLACE ((x{a} + x{b}) & {mask} AS x{a}) FROM ({sql}))"
        if r % 4 == 3:
            s = r // 4 + 1
            plus = [f"(x{j} + {ks[(s + j) % 5]}{f' + {s}' if j == 3 else ''}) & {mask} AS x{j}" for j in range(4)]
            sql = f"SELECT * REPLACE ({', '.join(plus)}) FROM ({sql})"
    return sql


IDS = "SELECT i0::uhugeint AS id FROM range((SELECT max(event_id) + 1 FROM events)) AS t(i0)"
#: First and second counter of each generator.
WORDS = f"w AS MATERIALIZED ({philox_sql(IDS, 0)}), w2 AS MATERIALIZED ({philox_sql(IDS, 1)})"
UNIT = lambda x: f"(({x} >> 11)::double / {2.0**53!r})"
RADIUS = lambda x: f"sqrt(-2 * ln(1 - {UNIT(x)}))"
TURN = lambda x: f"2 * pi() * {UNIT(x)}"
#: A range of 108 values: the few words above the last whole multiple, that would be drawn again, are one in 80 million.
WHOLE = lambda x: f"(({x} // {(1 << 32) // 108})::bigint - 10)::int"


def draws_sql(words: str, values: list[str]) -> str:
    """(i0, i1, v): draws of each generator, from the words of its first counter."""
    return f"WITH {words} " + " UNION ALL ".join(f"SELECT {k}::bigint AS i0, id::bigint AS i1, {v} AS v FROM w" for k, v in enumerate(values))


#: Counters whose words are enough for four draws that may be rejected.
COUNTERS = 24


def rejection_sql(attempt: str, value: str) -> str:
    """Draws that are tried until one is good: a walk along each generator's words.

    ``attempt`` selects, from (id, k, pos, spare, w), also next_pos, next_spare, good and what ``value`` needs.
    """
    words = f"SELECT id, list(x ORDER BY c, j) AS w FROM (SELECT id, c, unnest([0, 1, 2, 3]) AS j, unnest([x0, x1, x2, x3]) AS x FROM ({philox_sql(f'SELECT id, unnest(range({COUNTERS})) AS c FROM ({IDS})', 'c')})) GROUP BY id"
    return f"""WITH RECURSIVE words AS MATERIALIZED ({words}),
walk AS (
  SELECT id, 0 AS k, 0 AS pos, NULL::double AS spare, NULL::int AS done, NULL::double AS v FROM words
  UNION ALL
  SELECT id, CASE WHEN good THEN k + 1 ELSE k END, next_pos, CASE WHEN good THEN NULL ELSE next_spare END, CASE WHEN good THEN k END, CASE WHEN good THEN {value} END
  FROM ({attempt.format(source="(SELECT t.id, t.k, t.pos, t.spare, words.w FROM walk t JOIN words USING (id) WHERE t.k < 4)")}))
SELECT done::bigint AS i0, id::bigint AS i1, {R('v')} AS v FROM walk WHERE done IS NOT NULL"""


def gamma_sql(shape: float, scale: float) -> str:
    d = shape - 1 / 3
    c = 1 / (9 * d) ** 0.5
    pair = f"SELECT *, {RADIUS('w[pos + 1]')} AS r, {TURN('w[pos + 2]')} AS a, CASE WHEN spare IS NULL THEN pos + 2 ELSE pos END AS at2 FROM {{source}}"
    tried = f"SELECT *, coalesce(spare, r * cos(a)) AS x, CASE WHEN spare IS NULL THEN r * sin(a) END AS next_spare, 1 - {UNIT('w[at2 + 1]')} AS u, at2 + 1 AS next_pos FROM ({pair})"
    cubed = f"SELECT *, pow(1 + {c!r} * x, 3) AS cube FROM ({tried})"
    good = f"cube > 0 AND (u < 1 - 0.0331 * pow(x, 4) OR ln(u) < x * x / 2 + {d!r} * (1 - cube + ln(CASE WHEN cube > 0 THEN cube ELSE 1 END)))"
    return rejection_sql(f"SELECT *, {good} AS good FROM ({cubed})", f"{d!r} * cube * {scale!r}")


def vonmises_sql(mu: float, kappa: float) -> str:
    tau = 1 + (1 + 4 * kappa**2) ** 0.5
    rho = (tau - (2 * tau) ** 0.5) / (2 * kappa)
    r = (1 + rho**2) / (2 * rho)
    tried = f"SELECT *, cos(pi() * {UNIT('w[pos + 1]')}) AS z, 1 - {UNIT('w[pos + 2]')} AS u, CASE WHEN {UNIT('w[pos + 3]')} < 0.5 THEN -1 ELSE 1 END AS side FROM {{source}}"
    turned = f"SELECT *, (1 + {r!r} * z) / ({r!r} + z) AS f FROM ({tried})"
    judged = f"SELECT *, {kappa!r} * ({r!r} - f) AS c FROM ({turned})"
    good = "u < c * (2 - c) OR c <= ln(c / u) + 1"
    angle = f"side * acos(greatest(-1, least(1, f))) + {mu!r} + pi()"
    return rejection_sql(f"SELECT *, {good} AS good, CASE WHEN {good} THEN pos + 3 ELSE pos + 2 END AS next_pos, NULL::double AS next_spare FROM ({judged})", f"({angle}) - 2 * pi() * floor(({angle}) / (2 * pi())) - pi()")


def normal_complex_sql() -> str:
    parts = []
    for k in range(4):
        a, b = f"x{2 * (k % 2)}", f"x{2 * (k % 2) + 1}"
        radius = f"{RADIUS(a)} * 7 / sqrt(2)"
        parts.append(f"SELECT {k}::bigint AS i0, id::bigint AS i1, {R(f'{radius} * cos({TURN(b)}) - 3')} AS re, {R(f'{radius} * sin({TURN(b)}) + 4')} AS im FROM {'w' if k < 2 else 'w2'}")
    return f"WITH {WORDS} " + " UNION ALL ".join(parts)


ORACLES = {
    "reduce_sum": "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::bigint AS i0, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END::bigint AS i1, 0::bigint AS i2, sum(2 * round(l_extendedprice * 100)::bigint)::bigint AS v FROM lineitem GROUP BY 1, 2",
    "reduce_all": f"WITH {SIGNAL} SELECT 0::bigint AS i0, sum(v)::bigint AS v FROM s",
    "reduce_two_axes": f"WITH {MATRIX} SELECT 0::bigint AS i0, i1 // 8 AS i1, 0::bigint AS i2, sum(round(v * 1000)::bigint)::bigint AS v FROM e GROUP BY i1 // 8",
    "reduce_struct_minmax": f"WITH {USERS} SELECT i0, 0::bigint AS i1, min(v) AS cur_min, max(v) AS cur_max FROM u GROUP BY i0",
    "scan_inclusive": f"WITH {USERS} SELECT i0, i1, sum(v) OVER (PARTITION BY i0 ORDER BY i1)::bigint AS v FROM u",
    "scan_exclusive": f"WITH {USERS} SELECT i0, i1, coalesce(sum(v) OVER (PARTITION BY i0 ORDER BY i1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS v FROM u",
    "scan_global": f"WITH {SIGNAL} SELECT i0, sum(v) OVER (ORDER BY i0)::bigint AS v FROM s",
    "scan_global_exclusive": f"WITH {SIGNAL} SELECT i0, coalesce(sum(v) OVER (ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS v FROM s",
    "scan_max": f"WITH {SIGNAL} SELECT i0, max(v) OVER (ORDER BY i0) AS v FROM s",
    "scan_axes": f"WITH {MATRIX} SELECT i0, i1, sum(round(v * 1000)::bigint) OVER (ORDER BY i1, i0)::bigint AS v FROM e",
    "roll": f"WITH {SIGNAL} SELECT ((i0 - 1234) % n + n) % n AS i0, v FROM s, n",
    "roll_inplace": f"WITH {MATRIX} SELECT i0, (i1 + 70) % 64 AS i1, {R('v')} AS v FROM e",
    "fftshift": f"WITH {MATRIX} SELECT (i0 + n // 2) % n AS i0, (i1 + 32) % 64 AS i1, {R('v')} AS v FROM e, n",
    "fftshift_inverse": f"WITH {MATRIX} SELECT (i0 - n // 2 + n) % n AS i0, (i1 + 32) % 64 AS i1, {R('v')} AS v FROM e, n",
    "transpose": f"WITH {MATRIX} SELECT i1 AS i0, i0 AS i1, {R('v')} AS v FROM e",
    "transpose_axes": f"WITH {MATRIX} SELECT i1 % 4 AS i0, i0 AS i1, i1 // 4 AS i2, {R('v')} AS v FROM e",
    "copy": f"WITH {SIGNAL} SELECT i0, v FROM s",
    "copy_broadcasted": "SELECT r_regionkey::bigint AS i0, n_nationkey::bigint AS i1, n_regionkey AS v FROM region CROSS JOIN nation",
    "cast": "SELECT event_id AS i0, trunc(value)::int AS v FROM events",
    "arithmetic": f"WITH {SIGNAL} SELECT i0, (v * 3 + 11) * 2 - 7 AS v FROM s",
    "division": f"SELECT event_id AS i0, {R('value / 0.5 / 4.0')} AS v FROM events",
    "split_complex": f"WITH {PAIRS} SELECT i0, i1, {R('re')} AS re, {R('im')} AS im FROM z",
    "combine_complex": f"WITH {PAIRS} SELECT i0, i1, {R('re')} AS re, {R('im')} AS im FROM z",
    "norm_const": f"WITH {PAIRS} SELECT i0, i1, {R('pow(re * re + im * im, 1.5)')} AS v FROM z",
    "norm_param": f"WITH {PAIRS} SELECT i0, i1, {R('pow(re * re + im * im, 0.25)')} AS v FROM z",
    "ignore": f"WITH {PAIRS} SELECT i0, i1, {R('re')} AS v FROM z",
    "broadcast_value": "SELECT r_regionkey::bigint AS i0, n_nationkey::bigint AS i1, 7::bigint AS fixed, 9::bigint AS given FROM region CROSS JOIN nation",
    "pureparallel_join": f"WITH {SIGNAL} SELECT a.i0, (a.v + b.v)::bigint AS v FROM s a JOIN s b ON b.i0 = a.i0 // 2",
    "pureparallel_gather": f"WITH {SIGNAL} SELECT a.i0, a.v - b.v AS v FROM n, s a JOIN s b ON b.i0 = n.n - 1 - a.i0",
    "pureparallel_scatter": f"WITH {SIGNAL} SELECT i0, 0::bigint AS i1, v FROM s WHERE v % 2 = 0 UNION ALL SELECT i0, 1, v * v FROM s WHERE v % 2 = 0",
    "chunk_reduce": f"WITH {MATRIX} SELECT 0::bigint AS i0, i1, {R('sum(v)')} AS v FROM e GROUP BY i1", "chunk_transpose": f"WITH {MATRIX} SELECT i1 AS i0, i0 AS i1, {R('v')} AS v FROM e", "chunk_fft": dft(-1, "1"),
    "chunk_matmul": f"WITH {MATRIX} SELECT a.i1 AS i0, b.i1 AS i1, {R('sum(a.v * b.v)')} AS v FROM e a JOIN e b ON a.i0 = b.i0 GROUP BY 1, 2",
    "difference": f"WITH {SIGNAL} SELECT i0, (v - coalesce(lag(v) OVER (ORDER BY i0), 0))::bigint AS v FROM s",
    "matmul_gram": f"WITH {MATRIX} SELECT a.i1 AS i0, b.i1 AS i1, {R('sum(a.v * b.v)')} AS v FROM e a JOIN e b ON a.i0 = b.i0 GROUP BY 1, 2",
    "matmul_batch": f"WITH {MATRIX} SELECT a.i0, a.i1 // 8 AS i1, b.i1 % 8 AS i2, {R('sum(a.v * b.v)')} AS v FROM e a JOIN e b ON a.i0 = b.i0 AND a.i1 % 8 = b.i1 // 8 GROUP BY 1, 2, 3",
    "entrywise_norm": f"WITH {MATRIX} SELECT i0, 0::bigint AS i1, {R('sqrt(sum(v * v))')} AS v FROM e GROUP BY i0",
    "fft_lanes": dft(-1, "1"), "fft_inverse": dft(1, "1 / 64"), "fft_four_step": dft(-1, "1"), "fft_real_shifted": dft(-1, "1", 32), "fftn_by_transposes": dft(-1, "1"), "rfft": dft(-1, "1", half=True),
    "irfft_round_trip": f"WITH {MATRIX} SELECT i0, i1, {R('v')} AS v FROM e",
    "aprfft": f"WITH {MATRIX}, f AS (SELECT unnest(range(32)) AS k) SELECT i0, k AS i1, {R('2 * sum(v * cos(2 * pi() * ((i1 * (2 * k + 1)) % 128) / 128))')} AS re, {R('-2 * sum(v * sin(2 * pi() * ((i1 * (2 * k + 1)) % 128) / 128))')} AS im FROM e CROSS JOIN f GROUP BY i0, k",
    "dht_forward": dht_sql(DHT_MODES, 2, False), "dht_inverse": dht_sql(64, 1, True),
    "fft_chirp": f"WITH {SIGNAL}, {frames_sql(61, 31)}, k AS (SELECT unnest(range(61)) AS k) SELECT f AS i0, k AS i1, {R('sum(v * cos(2 * pi() * ((j * k) % 61) / 61))')} AS re, {R('-sum(v * sin(2 * pi() * ((j * k) % 61) / 61))')} AS im FROM f CROSS JOIN k GROUP BY f, k",
    "iaprfft_round_trip": f"WITH {MATRIX} SELECT i0, i1, {R('v')} AS v FROM e",
    "scan_generic": f"WITH {SIGNAL} SELECT i0, sum(v) OVER (ORDER BY i0)::bigint AS total, max(v) OVER (ORDER BY i0) AS top FROM s",
    "reduce_generic_monoid": f"WITH {SIGNAL} SELECT 0::bigint AS i0, list_reduce(list((v % 97 + 97) % 97 + 1), lambda a, b: (a * b) % 1000003)::bigint AS v FROM s",
    "cbrng_uniform_integer": draws_sql(WORDS, [WHOLE(x) for x in ("(x0 & 4294967295)", "(x0 >> 32)", "(x1 & 4294967295)", "(x1 >> 32)")]),
    "cbrng_threefry": draws_sql(f"w AS MATERIALIZED ({threefry_sql(IDS.replace('uhugeint', 'ubigint'))})", [WHOLE(f"x{j}") for j in range(4)]),
    "cbrng_uniform_float": draws_sql(WORDS, [f"{UNIT(f'x{j}')} * 12.7::double + -5.0::double" for j in range(4)]),
    "cbrng_normal": draws_sql(WORDS, [R(f"{RADIUS('x0')} * cos({TURN('x1')}) * 10 - 2"), R(f"{RADIUS('x0')} * sin({TURN('x1')}) * 10 - 2"), R(f"{RADIUS('x2')} * cos({TURN('x3')}) * 10 - 2"), R(f"{RADIUS('x2')} * sin({TURN('x3')}) * 10 - 2")]),
    "cbrng_normal_complex": normal_complex_sql(),
    "cbrng_gamma": gamma_sql(3.0, 10.0),
    "cbrng_vonmises": vonmises_sql(1.0, 0.7),
    "spectro_frames": f"WITH {SIGNAL}, {frames_sql(64, 16)} SELECT f AS i0, j AS i1, v FROM f",
    "spectrogram": f"WITH {SIGNAL}, {frames_sql(64, 16)}, w AS (SELECT f, j, v * 0.5 * (1 - cos(2 * pi() * j / 63)) AS v FROM f), k AS (SELECT unnest(range(33)) AS k) SELECT k AS i0, f AS i1, {R('sqrt(pow(sum(v * cos(2 * pi() * ((j * k) % 64) / 64)), 2) + pow(sum(v * sin(2 * pi() * ((j * k) % 64) / 64)), 2))')} AS v FROM w CROSS JOIN k GROUP BY f, k",
}

