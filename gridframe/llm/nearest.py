"""Exact top-k search by inner product with a pivot table.

Vectors become integers (``floor(256 * x)``). To search by distance, each row gets one
more component that lifts it to the common norm; then the largest inner product is the
smallest distance, and the triangle inequality over many pivots bounds it:
``d(q, x) >= max_p |d(q, p) - d(x, p)|``. Pivots are chosen once, from a sample of
``SAMPLE`` rows, and every row's distances to them are computed once and go with the row.

The k-th best score within the sample is a first threshold for every query. Queries are
put in groups of like nearest pivot (cell) and bounded size, and groups meet parts of the rows by a
shuffle on both numbers, in two rounds. First a row goes to the groups that hold queries of
its own cell, and the k-th scores found there become the queries' thresholds. Then it goes to
those other groups that its bound over the group's ranges does not exclude under these far
higher thresholds, so few rows move again and parts return few rows. A single group of
queries takes one round. There blocks of rows are excluded by their own ranges, and the
candidates left are evaluated in the order of their bound until none can reach the k-th
score. Scores are exact integers. Neither queries nor rows pass through the driver.

Defined results: vectors that are null, or hold null or non-finite components, take
no part; vectors of another length than a query's have no inner product with it;
ties go to the smaller id; a query with fewer other rows than k gets them all; rows
with a null id take no part; rows that repeat an id and vector count once, as queries and
as candidates; other vectors of one id are queries of their own, none of which has a
row of its id as a candidate; vectors may be of any length; extra columns of any name are left
aside; an empty table gives an empty result. Scores beyond 64 bits are held at the limits
of a long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Rows of the sample that pivots and first thresholds come from.
SAMPLE = 4096
PIVOTS = 32
#: Bytes of a group of queries in a task.
GROUP_BYTES = 32 << 20
#: Groups whose ranges are broadcast, to exclude rows before the shuffle; with more, rows go to all.
MAX_GROUPS = 10_000
#: Rows that meet a group in one part, and rows bounded together.
PART_ROWS = 200_000
ROW_BLOCK = 8192
#: Candidates of a query evaluated between two looks at the bound.
STEP = 256


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): clean vectors as whole doubles."""
    x = F.col(vector_col)
    clean = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    kept = df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & clean)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    top = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[-1])
    if top < 2**53:
        return (queries @ rows.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(q, r)) for r in rows] for q in queries]
    return np.array([[min(max(s, -(2**63)), 2**63 - 1) for s in line] for line in exact], dtype=np.int64).reshape(len(queries), len(rows))


def best_of(ids: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best different pairs, ties to the smaller id."""
    if len(ids) > 4 * k + 64:
        kth = np.partition(np.unique(found), -k)[-k] if len(np.unique(found)) > k else found.min()
        ids, found = ids[found >= kth], found[found >= kth]
    order = np.lexsort((ids, -found))
    ids, found = ids[order], found[order]
    first = np.concatenate(([True], (ids[1:] != ids[:-1]) | (found[1:] != found[:-1]))) if len(ids) else np.zeros(0, bool)
    return ids[first][:k], found[first][:k]


def pick_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other, one after the other."""
    if not len(vectors):
        return vectors
    chosen = [0]
    far = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


class PivotTable:
    """Pivots of one length of vectors, the common norm, and the sample."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, lift: float, pivots: int):
        self.ids, self.sample, self.lift = ids, sample, lift
        self.pivots = pick_pivots(sample, pivots)
        self.squares = (self.pivots**2).sum(axis=1)

    def distances(self, vectors: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances to the pivots; those of rows from the lifted vectors."""
        own = self.lift if lifted else (vectors**2).sum(axis=1)[:, None]
        with np.errstate(invalid="ignore", over="ignore"):
            return np.sqrt(np.maximum(0.0, own + self.squares[None, :] - 2 * vectors @ self.pivots.T)).astype(np.float32)

    def first_thresholds(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """k-th best score of each query within the sample; the least long if it has fewer."""
        out = np.full(len(ids), -(2**63), np.int64)
        for at in range(0, len(ids), 256):
            got = scores(queries[at : at + 256], self.sample)
            for n, (query_id, own) in enumerate(zip(ids[at : at + 256], got), at):
                _, top = best_of(self.ids[self.ids != query_id], own[self.ids != query_id], k)
                if len(top) == k:
                    out[n] = top[-1]
        return out


def most_of(lift: float, norm: np.ndarray, low: np.ndarray, scale: float) -> np.ndarray:
    """No row at a distance of ``low`` or more scores more than this; with room for rounding."""
    low = np.maximum(0.0, low - 1e-6 * scale)
    return (norm + lift - low * low) / 2 + 1e-6 * (1.0 + lift + norm)


class GroupSearch:
    """A group of queries and the best rows they have met."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, distances: np.ndarray, thresholds: np.ndarray, lift: float, k: int):
        self.ids, self.q, self.d, self.lift, self.k = ids, vectors, distances, lift, k
        self.norms = (vectors**2).sum(axis=1)
        self.least = thresholds.astype(float)
        self.top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.evaluated = 0

    def meet(self, ids: np.ndarray, rows: np.ndarray, distances: np.ndarray) -> None:
        """Take in a block of rows."""
        d = np.ascontiguousarray(distances.T)  # a pivot's distances side by side
        scale = float(max(d.max(initial=0.0), self.d.max(initial=0.0)))
        small = np.abs(self.q).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1] < 2**53
        with np.errstate(invalid="ignore"):
            gap = np.maximum(d.min(axis=1) - self.d, self.d - d.max(axis=1)).max(axis=1) if len(d) else np.zeros(len(self.ids))
            reaches = ~(most_of(self.lift, self.norms, gap, scale) < self.least)
        low, one = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
        for n in np.flatnonzero(reaches).tolist():
            low[:] = 0
            with np.errstate(invalid="ignore"):
                for own, mine in zip(d, self.d[n]):
                    np.subtract(own, mine, out=one)
                    np.maximum(low, np.abs(one, out=one), out=low)
                most = most_of(self.lift, self.norms[n], low.astype(float), scale)
                left = np.flatnonzero(~(most < self.least[n]))
            order = left[np.argsort(-most[left], kind="stable")]
            step, at = STEP, 0
            while at < len(order) and not most[order[at]] < self.least[n]:
                some = order[at : at + step]
                at, step = at + step, step * 4
                some = some[ids[some] != self.ids[n]]
                self.evaluated += len(some)
                got = (rows[some] @ self.q[n]).astype(np.int64) if small else scores(self.q[n][None, :], rows[some])[0]
                enough = got >= self.least[n]
                best = self.top[n]
                self.top[n] = best_of(np.concatenate((best[0], ids[some][enough])), np.concatenate((best[1], got[enough])), self.k)
                if len(self.top[n][1]) == self.k:
                    self.least[n] = max(self.least[n], float(self.top[n][1][-1]))


def arrays_of(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """Each value of a list column, without a copy."""
    column = batch.column(name)
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of the rows of each length."""
    vectors = arrays_of(batch, "v")
    lengths = np.array([len(v) for v in vectors])
    ids = batch.column("id").to_numpy()
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        yield length, ids[own], np.vstack([vectors[n] for n in own])


def batch_of(schema: dict, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(columns[n]) if schema[n] in LISTS else columns[n], schema[n]) for n in schema], names=list(schema))


LISTS = (pa.list_(pa.float64()), pa.list_(pa.float32()))
QUERIES = {"id": pa.int64(), "hash": pa.int64(), "v": LISTS[0], "length": pa.int32(), "cell": pa.int32(), "d": LISTS[1], "norm": pa.float64(), "least": pa.int64()}
MEETING = {"grp": pa.int32(), "part": pa.int32(), "kind": pa.int32(), "length": pa.int32(), "cell": pa.int32(), "id": pa.int64(), "v": LISTS[0], "d": LISTS[1], "least": pa.int64()}
FOUND = {"query_id": pa.int64(), "query_hash": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
SQL = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", LISTS[0]: "array<double>", LISTS[1]: "array<float>"}


def ddl(schema: dict) -> str:
    return ", ".join(f"{n} {SQL[t]}" for n, t in schema.items())


def pivot_tables(own: DataFrame, lifts: dict[int, float], pivots: int) -> dict[int, PivotTable]:
    """The table of each length, from the greatest squared norm of its rows; a length the sample misses has no pivots."""
    sample = own.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow()
    rows = defaultdict(lambda: ([], []))
    for row_id, v in zip(sample.column("id").to_pylist(), sample.column("v").to_pylist()):
        rows[len(v)][0].append(row_id)
        rows[len(v)][1].append(v)
    return {n: PivotTable(np.array(rows[n][0], np.int64), np.array(rows[n][1], float).reshape(-1, n), lift, pivots) for n, lift in lifts.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, group_bytes: int = GROUP_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row against all rows of ``vectors`` (id, v)."""
    spark = vectors.sparkSession
    sizes = lambda df, asked: df.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("lift"), F.lit(asked).alias("asked"))
    known = sizes(queries, True).unionAll(sizes(vectors, False)).collect()
    asked = sorted(r["n"] for r in known if r["asked"])
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = vectors.where(F.size("v").isin(asked))
    held = {r["n"]: r for r in known if not r["asked"] and r["n"] in asked}
    n_rows = sum(r["rows"] for r in held.values())
    tables = spark.sparkContext.broadcast(pivot_tables(own, {n: held[n]["lift"] if n in held else 0.0 for n in asked}, pivots))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for length, ids, own in by_length(batch):
                table = tables.value[length]
                d = table.distances(own, lifted=False)
                cell = d.argmin(axis=1) if d.shape[1] else np.zeros(len(ids), int)
                yield batch_of(QUERIES, id=ids, hash=vector_hashes(own), v=own, length=np.full(len(ids), length), cell=cell, d=d, norm=(own**2).sum(axis=1), least=table.first_thresholds(ids, own, k))

    ready = materialize(queries.dropDuplicates(["id", "v"]).mapInArrow(prepare, ddl(QUERIES)), "queries")
    # groups: queries in the order of length and cell, cut by size; their places in a cell are by hash
    cells = sorted((r["length"], r["cell"], r["c"]) for r in ready.groupBy("length", "cell").agg(F.count("*").alias("c")).collect())
    starts, group, room, last = [], -1, 0, None
    for length, cell, count in cells:
        size = max(1, group_bytes // (8 * (length + pivots)))
        if length != last:
            group, room, last = group + 1, size, length
        starts.append((length, cell, count, group, size - room, size))
        filled = size - room + count
        group, room = group + (filled - 1) // size, size - ((filled - 1) % size + 1)
    n_groups = group + 1
    places = F.broadcast(spark.createDataFrame(starts, "g_length int, g_cell int, n long, first int, used long, room long"))
    numbered = ready.join(places, (F.col("length") == F.col("g_length")) & (F.col("cell") == F.col("g_cell")))
    number = (F.col("first") + F.floor((F.col("used") + F.pmod(F.xxhash64("id", "v"), "n")) / F.col("room"))).cast("int")
    grouped = materialize(numbered.withColumn("grp", number).select("grp", *QUERIES), "query-groups")

    of_length = {n: sorted({g for m, _, c, first, used, room in starts if m == n for g in range(first, first + (used + c - 1) // room + 1)}) for n in asked}
    homes: dict[int, set[tuple[int, int]]] = defaultdict(set)  # the cells of a group's queries
    for length, cell, c, first, used, room in starts:
        for g in range(first + used // room, first + (used + c - 1) // room + 1):
            homes[g].add((length, cell))
    n_parts = max(1, -(-n_rows // part_rows), min(2 * spark.sparkContext.defaultParallelism, n_rows // (ROW_BLOCK // 4)))

    def group_ranges(grouped: DataFrame) -> dict | None:
        """By length: groups with the ranges of their distances, the greatest norm and the least threshold."""
        if n_groups > MAX_GROUPS:
            return None
        sides = [f(F.get("d", F.lit(i))).alias(f"{name}{i}") for i in range(pivots) for name, f in (("a", F.min), ("b", F.max))]
        out = defaultdict(lambda: ([], [], [], [], []))
        for r in grouped.groupBy("grp", "length").agg(F.max("norm").alias("norm"), F.min("least").alias("least"), *sides).collect():
            n = len(tables.value[r["length"]].pivots)
            for values, value in zip(out[r["length"]], (r["grp"], [r[f"a{i}"] for i in range(n)], [r[f"b{i}"] for i in range(n)], r["norm"], r["least"])):
                values.append(value)
        return {n: tuple(map(np.array, values)) for n, values in out.items()}

    def meeting(grouped: DataFrame, home: bool | None = None) -> DataFrame:
        """Rows with the groups that they go to, and the queries: rows in a cell of the group, or the others (or all) that its ranges leave."""
        known = spark.sparkContext.broadcast((None if home else group_ranges(grouped), of_length, dict(homes)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges, of_length, homes = known.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                for length, ids, rows in by_length(batch):
                    table = tables.value[length]
                    d = table.distances(rows, lifted=True)
                    cell = d.argmin(axis=1) if d.shape[1] else np.zeros(len(ids), int)
                    part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_parts
                    for n, group in enumerate(of_length[length] if ranges is None else ranges[length][0].tolist()):
                        at_home = np.isin(cell, [c for m, c in homes[group] if m == length])
                        stay = np.arange(len(ids)) if home is None else np.flatnonzero(at_home == home)
                        if ranges is not None and d.shape[1] and len(stay):
                            _, low, high, norm, least = (x[n] for x in ranges[length])
                            with np.errstate(invalid="ignore"):
                                gap = np.maximum(low - d[stay], d[stay] - high).max(axis=1).astype(float)
                                scale = max(float(d.max()), float(np.max(high)))
                                stay = stay[~(most_of(table.lift, np.asarray(norm), gap, scale) < float(least))]
                        if len(stay):
                            yield batch_of(MEETING, grp=np.full(len(stay), group), part=part[stay], kind=np.ones(len(stay), int), length=np.full(len(stay), length), cell=cell[stay], id=ids[stay], v=rows[stay], d=d[stay], least=np.zeros(len(stay), int))

        sent = grouped.select("grp", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.lit(0).alias("kind"), "length", "cell", "id", "v", "d", "least")
        return own.mapInArrow(deal, ddl(MEETING)).union(sent).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind", "cell")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, finder, hashes = None, {0: [], 1: []}, None, None

        def begin() -> None:
            nonlocal finder, hashes
            ids, vectors, d, least = zip(*waiting[0])
            finder = GroupSearch(np.array(ids), np.vstack(vectors), np.vstack(d), np.array(least), tables.value[len(vectors[0])].lift, k)
            hashes = vector_hashes(finder.q)
            waiting[0] = []

        def meet() -> None:
            if waiting[0]:
                begin()
            if waiting[1] and finder is not None:
                ids, vectors, d, _ = zip(*waiting[1])
                finder.meet(np.array(ids), np.vstack(vectors), np.vstack(d))
            waiting[1] = []

        def result() -> Iterator[pa.RecordBatch]:
            meet()
            if finder is not None:
                sizes = [len(t[0]) for t in finder.top]
                yield batch_of(FOUND, query_id=np.repeat(finder.ids, sizes), query_hash=np.repeat(hashes, sizes), vec_id=np.concatenate([t[0] for t in finder.top]), score=np.concatenate([t[1] for t in finder.top]))

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "kind")), batch.column("id").to_pylist(), arrays_of(batch, "v"), arrays_of(batch, "d"), batch.column("least").to_pylist())
            for group, part, kind, *row in rows:
                if key != (group, part):
                    if key is not None:
                        yield from result()
                    key, finder = (group, part), None
                waiting[kind].append(row)
                if len(waiting[1]) >= ROW_BLOCK:
                    meet()
        if key is not None:
            yield from result()

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
        return found.dropDuplicates().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if n_groups == 1:  # there are no other groups to keep rows from
        return best(meeting(grouped).mapInArrow(search, ddl(FOUND))).select("query_id", "rank", "vec_id", "score")
    # rows at home first: the k-th scores that they give are the thresholds for all others
    near = materialize(best(meeting(grouped, True).mapInArrow(search, ddl(FOUND))).select(*FOUND, "rank"), "near-rows")
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_hash").alias("hash"), F.col("score").alias("kth"))
    raised = grouped.join(kth, ["id", "hash"], "left").withColumn("least", F.greatest("least", "kth")).select("grp", *QUERIES)
    far = meeting(materialize(raised, "raised-queries"), False).mapInArrow(search, ddl(FOUND))
    return best(near.select(*FOUND).union(far)).select("query_id", "rank", "vec_id", "score")


def vector_hashes(vectors: np.ndarray) -> np.ndarray:
    """A signed number of each vector, to tell queries of one id apart."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in vectors], np.uint64).view(np.int64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


#: Result in DuckDB's SQL: the same integers, every query row against every other row.
ORACLE = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::double))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM clean q JOIN clean c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::int AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
