"""The SimHash operator carried on to a Jaccard similarity of word shingles, for the pipeline's stage.

Candidates are the links of ``simhash``: fingerprints within ``DISTANCE`` bits, found by
deletion-variant signatures. Texts of 0.8 similarity differ in about 10 of 64 bits and
often in more, too far for segments of a fingerprint, so pairs of equal MinHash keys
join them: ``BANDS`` keys of ``BAND_ROWS`` minima each, by which a pair of similarity s is missed
with probability (1 - s^5)^32: 3e-6 at 0.8, less above. Every link is verified on the
whole shingle sets, so no pair below the threshold is one.

Texts with equal words are one class. First fingerprint links are verified, and each class
of a key with the key's head, the class that most others share keys with. Classes of keys
that are not yet connected then meet by an exact prefix filter: with shingles in the order of
their frequency among these classes, two sets of similarity 0.8 share one of the first
n - ceil(0.8 n) + 1 of either, so classes meet under those alone, and boilerplate that many
texts share brings none together. So a large group of near copies gives links in proportion
to its members, and yet the components are those of all candidates.

Defined results: null and empty texts are copies of each other; fewer words than a
shingle give one shingle of all words; repeated rows are copies; very long texts are read
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, spread
from .components import connected_components
from .simhash import links as fingerprint_links
from .simhash import majority, shingles

WORDS = 5
MIN_SIMILARITY = 0.8
#: Bits that fingerprints of candidates differ in at most.
DISTANCE = 4
BANDS, BAND_ROWS = 32, 5
#: Classes with a candidate that are broadcast to find their texts; more are joined by a shuffle.
MAX_BROADCAST = 500_000
#: Fixed permutations: (hash xor salt) * odd factor.
SALTS, FACTORS = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
FACTORS |= np.uint64(1)
CHUNK = 1024
#: Bytes of text that a worker reads at once (a single text may hold more).
READ_BYTES = 1 << 20


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima, as signed numbers."""
    import xxhash

    low = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), CHUNK):
        np.minimum(low, ((hashes[at : at + CHUNK, None] ^ SALTS) * FACTORS).min(axis=0), out=low)
    keys = [xxhash.xxh64_intdigest(low[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(rows: DataFrame) -> DataFrame:
    """(row, node, n, fp, keys): class of the words, number of distinct shingles, fingerprint, band keys."""

    def run(batch: pa.RecordBatch) -> dict:
        import xxhash

        nodes, sizes, fps, keys = [], [], [], []
        for text in batch.column("text").to_pylist():
            hashes = shingles(text, WORDS)
            fps.append(majority(hashes))
            hashes = np.unique(hashes)
            nodes.append(xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), 7))
            sizes.append(len(hashes))
            keys.append(band_keys(hashes))
        return {"row": batch.column("row"), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "n": pa.array(sizes, pa.int32()), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "keys": pa.array(keys, pa.list_(pa.int64()))}

    return map_batches(rows, run, "row long, node long, n int, fp long, keys array<long>", READ_BYTES)


def shingle_sets(nodes: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles): whole shingle sets of the classes in ``nodes`` (p)."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [np.unique(shingles(t, WORDS)).view(np.int64) for t in batch.column("text").to_pylist()]
        return {"node": batch.column("node"), "shingles": pa.array(sets, pa.list_(pa.int64()))}

    firsts = materialize(classes.join(nodes, F.col("node") == F.col("p")).select(F.col("first").alias("first_row"), "node"), "near-firsts")
    if firsts.count() <= MAX_BROADCAST:
        firsts = F.broadcast(firsts)
    texts = rows.join(firsts, F.col("row") == F.col("first_row")).select("node", "text")
    return materialize(map_batches(texts, run, "node long, shingles array<long>", READ_BYTES), "near-sets")


def verified(pairs: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """(a, b): the pairs whose whole shingle sets are similar enough."""
    one, two = (sets.select(F.col("node").alias(f"node_{k}"), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    met = pairs.join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return materialize(met.where(both >= F.lit(min_similarity) * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"), "near-links")


def ends(pairs: DataFrame) -> DataFrame:
    """(p): the classes of pairs."""
    return pairs.select(F.col("a").alias("p")).union(pairs.select(F.col("b").alias("p"))).distinct()


def fingerprint_pairs(classes: DataFrame, min_similarity: float) -> DataFrame:
    """(a, b): classes of one fingerprint with the first of them, and the first one of each fingerprint with that of its smallest link."""
    firsts = classes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("h"))
    firsts = materialize(firsts.select("fp", F.col("h.node").alias("head"), F.col("h.n").alias("head_n")), "near-fingerprints")
    same = classes.join(firsts.withColumnRenamed("fp", "head_fp"), F.col("fp") == F.col("head_fp")).where(F.col("node") != F.col("head")).select("head", "head_n", "node", "n")
    linked = materialize(fingerprint_links(firsts.select("fp"), DISTANCE).groupBy("b").agg(F.min("a").alias("a")), "near-fingerprint-links")
    one, two = (firsts.select(F.col("fp").alias(f"fp_{k}"), F.col("head").alias(f"head_{k}"), F.col("head_n").alias(f"n_{k}")) for k in "ab")
    met = linked.join(one, F.col("a") == F.col("fp_a")).join(two, F.col("b") == F.col("fp_b"))
    pairs = same.union(met.select("head_a", "n_a", "head_b", "n_b"))
    return pairs.where(sizes_fit(min_similarity)).select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))


def sizes_fit(min_similarity: float):
    """Whether sets of these sizes can be similar enough."""
    return F.least("n", "head_n") >= F.lit(min_similarity) * F.greatest("n", "head_n")


def rarest(nodes: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """(node, n, root, common, place, s) of ``nodes`` (node, n, root): the shingles under which a class has to meet what is similar to it.

    A set of n shingles, ordered by how many of ``nodes`` have them, shares one of its first
    n - ceil(t n) + 1 with any set of similarity t. Those that only it has come first
    and meet nobody; ``common`` are the others.
    """
    words = sets.join(nodes.select(F.col("node").alias("p")), F.col("node") == F.col("p"), "left_semi").select("node", F.explode("shingles").alias("s"))
    counts = words.groupBy(F.col("s").alias("c_s")).agg(F.count("*").alias("c")).where("c > 1")
    met = words.join(counts, F.col("s") == F.col("c_s"))
    shared = met.groupBy(F.col("node").alias("s_node")).agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("shared"))  # a text's shingles at most
    least = F.lit(min_similarity) * F.col("n") - F.lit(1e-9)
    own = F.col("n") - F.size("shared")
    kept = nodes.join(shared, F.col("node") == F.col("s_node")).where(F.size("shared") >= least)
    first = F.slice("shared", F.lit(1), (F.col("n") - F.ceil(least) + 1 - own).cast("int"))
    out = kept.select("node", "n", "root", F.size("shared").alias("common"), own.alias("own"), F.posexplode(first).alias("at", "x"))
    return out.select("node", "n", "root", "common", (F.col("own") + F.col("at")).alias("place"), F.col("x.s").alias("s"))


def prefix_pairs(nodes: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """(a, b): pairs of different roots that may be similar enough, none that is left out."""
    one = materialize(rarest(nodes, sets, min_similarity), "near-rarest")
    other = one.select(*[F.col(c).alias(f"head_{c}" if c != "node" else "head") for c in one.columns])
    # what two sets share: no more than either shares with any other, and than what comes after the first shingle they share
    needed = F.lit(min_similarity / (1 + min_similarity)) * (F.col("n") + F.col("head_n")) - F.lit(1e-9)
    after = F.least(F.col("n") - F.col("place"), F.col("head_n") - F.col("head_place"))
    met = (F.col("s") == F.col("head_s")) & (F.col("head") < F.col("node")) & (F.col("head_root") != F.col("root")) & sizes_fit(min_similarity)
    pairs = one.join(other, met & (F.least("common", "head_common", after) >= needed))
    return materialize(pairs.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")


def near_copies(rows: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(row, root) of ``rows`` (row, text); rows of one root are linked. ``row`` is unique and ``rows`` a written table."""
    rows = rows.select("row", F.coalesce("text", F.lit("")).alias("text"))
    seen = materialize(sketches(spread(rows)), "near-sketches")
    grouped = seen.groupBy("node").agg(F.min(F.struct("row", "n", "fp", "keys")).alias("m"))
    classes = materialize(grouped.select("node", F.col("m.row").alias("first"), "m.n", "m.fp", "m.keys"), "near-classes")

    met = classes.select("node", "n", F.explode("keys").alias("key"))
    counts = materialize(met.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumnRenamed("key", "c_key"), "near-keys")
    shared = materialize(met.join(counts, F.col("key") == F.col("c_key")).select("key", "node", "n", "c"), "near-shared")
    # the head of a key is the class that shares keys with most others: of a group of near copies, the one they come from
    known = materialize(shared.groupBy(F.col("node").alias("k_node")).agg(F.sum("c").alias("known")), "near-known")
    ranked = shared.join(known, F.col("node") == F.col("k_node"))
    heads = ranked.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("known", "node")).alias("h"))
    heads = materialize(heads.select(F.col("key").alias("head_key"), F.col("h.node").alias("head"), F.col("h.n").alias("head_n")), "near-heads")
    star = shared.join(heads, F.col("key") == F.col("head_key")).where((F.col("node") != F.col("head")) & sizes_fit(min_similarity))
    star = star.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
    pairs = materialize(fingerprint_pairs(classes, min_similarity).union(star).distinct(), "near-star")
    links = verified(pairs, shingle_sets(ends(pairs), rows, classes), min_similarity)

    roots = connected_components(links, "near-roots")
    apart = shared.join(roots.select(F.col("node").alias("r_node"), "root"), F.col("node") == F.col("r_node"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed = materialize(mixed.select(F.col("key").alias("mixed_key")), "near-mixed")
    left = materialize(apart.join(mixed, F.col("key") == F.col("mixed_key"), "left_semi"), "near-apart")
    if not left.isEmpty():
        nodes = materialize(left.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root")), "near-left")
        sets = shingle_sets(nodes.select(F.col("node").alias("p")), rows, classes)
        pairs = prefix_pairs(nodes, sets, min_similarity)
        more = verified(pairs, sets, min_similarity)
        if not more.isEmpty():
            roots = connected_components(links.union(more), "near-roots")
    found = seen.select("row", "node").join(roots.select(F.col("node").alias("r_node"), "root"), F.col("node") == F.col("r_node"), "left")
    return found.select("row", F.coalesce("root", "node").alias("root"))
