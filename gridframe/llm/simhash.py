"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints within ``distance`` bits are found without comparing all pairs: the 64
bits are cut into ``distance // 2 + 1`` segments (three for four bits), fewer than
exact matching would need, so that at least one segment of a linked pair differs by
one bit at most. Each segment is indexed under its one-wildcard variants (the
segment with one bit deleted, once for every bit); two segments within one bit share
a variant. Equal variants meet by a shuffle on the variant, and whole fingerprints
are then verified.

Exact copies count once, as one distinct fingerprint. Within a variant's run only
a spanning forest of the verified links is kept, so a group of many near copies
gives links in proportion to its members. A segment that more than ``LONG_RUN`` fingerprints
share is counted beforehand; its variants' runs are cut by salt, and each pair of parts
meets in a task of its own.

Defined results: null and empty texts have the fingerprint zero and are linked like
any other; fewer words than a shingle give one shingle of all words; rows with a null
id are left out; every row is linked by its own fingerprint and an id links nothing, so rows of
one id with other texts may be in components of their own, and repeated rows repeat their
result; very long texts are read whole; extra columns of any name are left aside; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, read_table, spread, text_rows
from .components import connected_components

LANES = np.uint64(0x0101010101010101)


def shingles(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle; of all words if they are fewer; 0 without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(1, np.uint64)
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())), np.uint64, len(parts) - words + 1)


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of the word shingles' XXH64 (seed 42)."""
    return majority(shingles(text, words))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, counted in eight byte lanes at a time."""
    n = len(hashes)
    pad = -n % 255
    blocks = np.concatenate((hashes, np.zeros(pad, np.uint64))).reshape(-1, 255) if n > 255 else hashes[None, :]
    out = 0
    for k in range(8):
        lanes = ((blocks >> np.uint64(k)) & LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            if 2 * int(counts[byte]) > n:
                out |= 1 << (8 * byte + k)
    return out


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every text, as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return {"id": batch.column("id"), "fp": pa.array(fps.view(np.int64))}

    return map_batches(spread(text_rows(docs, id_col, text_col).where("id is not null")), run, "id long, fp long")


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, size) of ``distance // 2 + 1`` segments."""
    n = distance // 2 + 1
    sizes = [bits // n + (k < bits % n) for k in range(n)]
    return [(sum(sizes[:k]), size) for k, size in enumerate(sizes)]


def segment_of(number: int, distance: int) -> Column:
    """A segment's bits."""
    at, size = segments(distance)[number]
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def variant_keys(cut: Column, number: int, size: int) -> list[Column]:
    """The segment with each bit deleted, tagged by segment and bit."""
    keys = []
    for bit in range(size):
        low, high = (1 << bit) - 1, ~((1 << (bit + 1)) - 1)
        rest = cut.bitwiseAND(F.lit(low).cast("long")).bitwiseOR(F.shiftright(cut.bitwiseAND(F.lit(high).cast("long")), 1))
        keys.append(rest.bitwiseOR(F.lit((number * 64 + bit) << 48).cast("long")))
    return keys


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """(variant, fp) of every segment."""
    keys = [key for number, (_, size) in enumerate(segments(distance)) for key in variant_keys(segment_of(number, distance), number, size)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("variant"))


def long_runs(fps: DataFrame, distance: int, long_run: int) -> DataFrame:
    """(hot, salts): variants whose run may be longer than ``long_run``, as two values of a segment make a run."""
    values = F.array(*[F.struct(F.lit(n).alias("number"), segment_of(n, distance).alias("value")) for n in range(len(segments(distance)))])
    counts = fps.select(F.explode(values).alias("s")).groupBy("s.number", "s.value").agg(F.count("*").alias("n")).where(2 * F.col("n") > long_run)
    parts = []
    for number, (_, size) in enumerate(segments(distance)):
        own = counts.where(F.col("number") == number)
        parts.append(own.select(F.explode(F.array(*variant_keys(F.col("value"), number, size))).alias("hot"), F.ceil(2 * F.col("n") / long_run).cast("int").alias("salts")))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.groupBy("hot").agg(F.max("salts").alias("salts"))


def salted(met: DataFrame, hot: DataFrame) -> DataFrame:
    """``met`` with the rows of hot variants once for each pair of salts they take part in."""
    hot = F.broadcast(hot) if hot.count() <= MAX_BROADCAST else hot
    joined = met.join(hot, F.col("variant") == F.col("hot"), "left")
    plain = joined.where(F.col("salts").isNull()).select("fp", "variant")
    own = F.pmod(F.xxhash64("fp"), F.col("salts"))
    some = joined.where(F.col("salts").isNotNull()).select("fp", "variant", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other"))
    return plain.union(some.select("fp", F.xxhash64("variant", F.least("own", "other"), F.greatest("own", "other")).alias("variant")))


#: Fingerprints of a run beyond which it is cut by salt; hot variants that are broadcast.
LONG_RUN = 200_000
MAX_BROADCAST = 200_000
#: Runs of a variant up to this size are compared offset by offset, all runs at once.
SHORT_RUN = 48


def run_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links in each run of equal keys; (smaller, larger) fingerprints. Keys are sorted."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    starts, sizes = edge[:-1], np.diff(edge)
    out_a, out_b = [], []
    short = (sizes > 1) & (sizes <= SHORT_RUN)
    if short.any():
        room = np.zeros(len(keys), np.int64)  # rows after this one in its run
        s, z = starts[short], sizes[short]
        rows = np.repeat(s, z) + (np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z))
        room[rows] = np.repeat(s + z, z) - rows - 1
        for offset in range(1, int(z.max())):
            rows = rows[room[rows] >= offset]
            near = np.bitwise_count((fps[rows] ^ fps[rows + offset]).view(np.uint64)) <= distance
            out_a.append(fps[rows[near]])
            out_b.append(fps[rows[near] + offset])
    for s, z in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist()):
        a, b = forest(fps[s : s + z], distance)
        out_a.append(a)
        out_b.append(b)
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a long run: a breadth-first walk that never looks at a reached row again."""
    left = np.unique(fps)
    out_a, out_b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        root = queue[0]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= distance
            if near.any():
                reached = left[near]
                out_a.append(np.full(len(reached), root))
                out_b.append(reached)
                queue.extend(reached)
                left = left[~near]
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


#: Rows of sorted variants compared at once; a run that is open at the end waits for the rest.
BLOCK_ROWS = 1_000_000


def links(fps: DataFrame, distance: int, long_run: int = LONG_RUN) -> DataFrame:
    """(a, b): links whose transitive closure is that of all pairs within ``distance`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, waiting = [], [], 0

        def compared(final: bool):
            nonlocal keys, values, waiting
            k, v = np.concatenate(keys), np.concatenate(values)
            done = len(k) if final else int(np.searchsorted(k, k[-1]))
            keys, values, waiting = [k[done:]], [v[done:]], len(k) - done
            a, b = run_links(k[:done], v[:done], distance) if done else (k[:0], k[:0])
            return pa.RecordBatch.from_pydict({"a": a, "b": b})

        for batch in batches:
            keys.append(batch.column("variant").to_numpy())
            values.append(batch.column("fp").to_numpy())
            waiting += batch.num_rows
            if waiting >= BLOCK_ROWS:
                yield compared(False)
        if keys:
            yield compared(True)

    met = variants(fps, distance)
    hot = materialize(long_runs(fps, distance, long_run), "fingerprint-runs")
    if not hot.isEmpty():
        met = salted(met, hot)
    met = met.repartition("variant").sortWithinPartitions("variant")
    return met.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", long_run: int = LONG_RUN) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links."""
    rows = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "fingerprint-classes")
    roots = connected_components(links(classes.select("fp"), distance, long_run), "fingerprint-roots")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # a table of its own, so that the join back can be split where a component is large
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component")).withColumnRenamed("root", "least_root"), "fingerprint-components")
    named = rooted.join(least, F.col("root") == F.col("least_root")).select(F.col("fp").alias("class_fp"), "component")
    return rows.join(named, F.col("fp") == F.col("class_fp")).select("id", "fp", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
