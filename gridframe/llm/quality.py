"""Quality classifier: Bradley-Terry ranking from preference pairs.

Each text becomes counts of signs, words and lines, as shares that do not grow with
the text. A good text beats a bad one: weights are the optimum of logistic loss on the
differences of features, over all pairs of a good and a bad training row. The decision
threshold is a quantile of the training scores (the share of bad labels), and a score is
the logistic of the distance from it, so 0.5 is the threshold.

Every labelled row that is not held out takes part in every figure of the model: means,
exact quantiles, loss and threshold. Training rows lie in blocks; each step of the fit is
one pass over the blocks, whose small results are merged in a tree, in order. The sums
over all pairs need no pairs: the slope of a row is a smooth function of its score, that of
all scores of the other label, which are counted on a grid of cubic interpolation (spacing
``GRID``, error below 1e-8 of a pair's loss).

Defined results: null and empty texts are scored by their (zero) features; rows with
a null id are scored, with ``held_out`` null; repeated rows repeat their result and are
learnt once, different texts of one id are all learnt; a document with both labels counts
once for each, repeated labels count once; tied scores are on the same side of the
threshold; without rows of both labels every score is the share of good labels (0.5 if
there are none); very long texts are read whole; extra columns of any name are left aside;
an empty table gives an empty result.
"""

from __future__ import annotations

import operator
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_batches, materialize, read_table, scratch, spread, text_rows

#: Training rows of a block.
BLOCK_ROWS = 16_384
#: Results that are merged in one group, until one is left.
FAN = 8
KNOTS = (0.1, 0.3, 0.5, 0.7, 0.9, 0.97)
#: Weight of the squared norm, halved, beside the mean loss of a pair.
RIDGE = 1e-3
#: Spacing of the grid that scores are counted on, and of the coarse one for second derivatives.
GRID, COARSE = 1 / 32, 1 / 4
#: Coarse places on either side of zero.
SIDE = 64
#: Parts that a pass of ``select`` cuts a range of values in.
PARTS = 512

#: ``fold(part, merge)``: what ``part`` makes of the features and labels of each block, merged; None without rows.
Fold = Callable[[Callable, Callable], object]


def features(text: str) -> list[float]:
    """Shares and averages of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    signs = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    ends = count[46] + count[44]
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    pairs = list(zip(words, words[1:]))
    stammer = sum(map(operator.eq, words, words[1:])) if len(words) > 1 else 0
    window = [len(set(words[at : at + 100])) / len(words[at : at + 100]) for at in range(0, len(words), 100)] or [0.0]
    return [
        np.log1p(len(text)), upper / size, lower / size, digit / size, signs / size, ends / n, (signs - ends) / n, count[10] / n,
        count[124] / n, count[33] / n, count[35] / n, count[36] / n, count[37] / n, count[38] / n, count[42] / n, (count[60] + count[62] + count[123] + count[125]) / n, count[47] / n, count[64] / n, count[95] / n,
        len(text) / n, len(set(words)) / n, float(np.mean(window)), float(np.min(window)), stammer / n, len(set(pairs)) / n, len(set(lines)) / len(lines), len(lines) / n,
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, count[128:].sum() / size, len(zlib.compress(data, 1)) / size, float(len(words) < 5),
    ]


def added(a, b):
    """Sums of two results, part by part."""
    return tuple(x + y for x, y in zip(a, b))


def sigmoid(u: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(u, -40, 40)))


def as_keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def as_values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys ^ np.uint64(1 << 63), ~keys).view(np.float64)


def select(fold: Fold, values: Callable, columns: list[int], reached: list[Callable]) -> np.ndarray:
    """For each goal the least value of its column up to which the counts (bad, good) reach it, exactly.

    A pass counts the rows up to the ends of the parts of each goal's range; the part where
    the goal is reached, without what holds no row, is the next range.
    """
    low, high = as_keys(np.array([-np.inf, np.inf]))
    lo, hi = np.full(len(columns), low), np.full(len(columns), high)
    while (open_ := np.flatnonzero(lo < hi)).size:
        step = (hi[open_] - lo[open_]) // np.uint64(PARTS) + np.uint64(1)
        ends = np.minimum(lo[open_, None] + step[:, None] * np.arange(1, PARTS + 1, dtype=np.uint64) - np.uint64(1), hi[open_, None])
        least, most, of = lo[open_], hi[open_], [columns[k] for k in open_]

        def part(x, good):
            table = values(x)
            counts, first, last = np.zeros((len(of), PARTS, 2), np.int64), np.full(len(of), high), np.full(len(of), low)
            for column in set(of):
                keys = as_keys(np.ascontiguousarray(table[:, column]))
                kinds = np.sort(keys[~good]), np.sort(keys[good])
                for k in (k for k, c in enumerate(of) if c == column):
                    for label, kind in enumerate(kinds):
                        counts[k, :, label] = np.searchsorted(kind, ends[k], side="right")
                        inside = kind[np.searchsorted(kind, least[k]) : counts[k, -1, label]]
                        if inside.size:
                            first[k], last[k] = min(first[k], inside[0]), max(last[k], inside[-1])
            return counts, first, last

        counts, first, last = fold(part, lambda a, b: (a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])))
        at = np.array([np.argmax(reached[k](counts[n, :, 0], counts[n, :, 1])) for n, k in enumerate(open_)])
        begin = least + step * at.astype(np.uint64)
        lo[open_], hi[open_] = np.maximum(begin, first), np.minimum(ends[np.arange(len(at)), at], last)
    return as_values(lo)


def places(scores: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """First of four places of the grid around each score, and their shares in it."""
    at = np.floor(scores / GRID)
    u = scores / GRID - at
    shares = [-u * (u - 1) * (u - 2) / 6, (u + 1) * (u - 1) * (u - 2) / 2, -(u + 1) * u * (u - 2) / 2, (u + 1) * u * (u - 1) / 6]
    return at.astype(np.int64) - 1, shares


def coarse(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(scores / COARSE), -SIDE, SIDE).astype(np.int64) + SIDE


class Counts:
    """Scores of bad and good rows, counted on the grid and on the coarse one."""

    def __init__(self, scores: np.ndarray, good: np.ndarray):
        at, shares = places(scores)
        self.first, size = int(at.min()), int(at.max() - at.min()) + 4
        self.fine, self.rough = np.zeros((2, size)), np.zeros((2, 2 * SIDE + 1))
        for label, rows in enumerate((~good, good)):
            for k, share in enumerate(shares):
                self.fine[label] += np.bincount(at[rows] + k - self.first, share[rows], size)
            self.rough[label] = np.bincount(coarse(scores[rows]), minlength=2 * SIDE + 1)

    def merge(self, other: Counts) -> Counts:
        first = min(self.first, other.first)
        size = max(c.first + c.fine.shape[1] for c in (self, other)) - first
        fine = np.zeros((2, size))
        for c in (self, other):
            fine[:, c.first - first : c.first - first + c.fine.shape[1]] += c.fine
        self.first, self.fine, self.rough = first, fine, self.rough + other.rough
        return self

    def under(self, label: int, kernel: Callable) -> np.ndarray:
        """At each place the sum of ``kernel(distance)`` over the scores of a label."""
        size = self.fine.shape[1]
        n = 1 << (3 * size).bit_length()
        both = np.fft.rfft(self.fine[label], n) * np.fft.rfft(kernel(np.arange(1 - size, size) * GRID), n)
        return np.fft.irfft(both, n)[size - 1 : 2 * size - 1]

    def loss(self) -> float:
        """Mean over all pairs."""
        return float(self.fine[1] @ self.under(0, lambda d: np.logaddexp(0, -d)) / self.rough.sum(axis=1).prod())

    def slopes(self) -> np.ndarray:
        """At each place the slope of the mean loss in the score of a bad row, and of a good one."""
        return np.stack([self.under(1, sigmoid), -self.under(0, lambda d: sigmoid(-d))]) / self.rough.sum(axis=1).prod()

    def bends(self) -> np.ndarray:
        """Second derivative of the mean loss in a pair's distance, by coarse places of its rows."""
        t = np.arange(-SIDE, SIDE + 1) * COARSE
        s = sigmoid(t[:, None] - t[None, :])
        return s * (1 - s) / self.rough.sum(axis=1).prod()


class Ranker:
    """Bradley-Terry weights over features and their hinges."""

    def __init__(self, x: np.ndarray, good: np.ndarray, share_good: float):
        self.learn(lambda part, merge: part(x, good) if len(x) else None, share_good)

    @classmethod
    def over(cls, fold: Fold, share_good: float) -> Ranker:
        """From rows that are only reached by passes."""
        made = cls.__new__(cls)
        made.learn(fold, share_good)
        return made

    def learn(self, fold: Fold, share: float) -> None:
        self.base = share
        self.weights = None
        start = fold(lambda x, good: (np.array([(~good).sum(), good.sum()]), x.sum(axis=0)), added)
        if start is None or not start[0].all():
            return
        (n_bad, n_good), n = start[0].tolist(), int(start[0].sum())
        mean = self.mean = start[1] / n
        self.spread = np.sqrt(fold(lambda x, good: (((x - mean) ** 2).sum(axis=0),), added)[0] / n) + 1e-6
        self.knots = (self.quantiles(fold, n, len(mean)) - self.mean) / self.spread
        self.weights = self.optimum(fold, np.zeros(len(mean) * (1 + len(KNOTS))))

        def reached(bad, good):
            return share * good / n_good + (1 - share) * bad / n_bad >= 1 - share - 1e-12

        below = select(fold, lambda x: self.raw(x)[:, None], [0], [reached])[0]  # leaves the share of bad labels below

        def above(x, good):
            s = self.raw(x)
            return s[s > below].min(initial=np.inf)

        following = fold(above, min)
        self.threshold = float((below + following) / 2 if following < np.inf else below)

    def quantiles(self, fold: Fold, n: int, width: int) -> np.ndarray:
        """Exact quantiles of every feature, between neighbours by their distance."""
        at = [q * (n - 1) for q in KNOTS]
        ranks = [r for a in at for r in (int(a), min(int(a) + 1, n - 1))]
        goals = [lambda bad, good, r=r: bad + good > r for r in ranks] * width
        found = select(fold, lambda x: x, [c for c in range(width) for _ in ranks], goals).reshape(width, len(at), 2)
        return (found[:, :, 0] + (found[:, :, 1] - found[:, :, 0]) * np.array([a - int(a) for a in at])).T

    def optimum(self, fold: Fold, w: np.ndarray) -> np.ndarray:
        """Newton's method; two passes a step, one to count scores and one for derivatives."""

        def counted(w):
            return fold(lambda x, good: Counts(self.raw(x, w), good), Counts.merge)

        counts = counted(w)
        for _ in range(60):
            slopes, bends = counts.slopes(), counts.bends()
            weights = np.stack([bends @ counts.rough[1], bends @ counts.rough[0]])

            def part(x, good, w=w, first=counts.first, slopes=slopes, weights=weights):
                table, label = self.expand(x), good.astype(np.int64)
                scores = (table * w).sum(axis=1)
                at, shares = places(scores)
                slope = sum(share * slopes[label, at + k - first] for k, share in enumerate(shares))
                rough = coarse(scores)
                cell = label * (2 * SIDE + 1) + rough
                order = np.argsort(cell, kind="stable")
                cells, starts = np.unique(cell[order], return_index=True)
                sums = np.zeros((2 * (2 * SIDE + 1), len(w)))
                sums[cells] = np.add.reduceat(table[order], starts)
                return slope @ table, (table * weights[label, rough][:, None]).T @ table, sums

            slope, square, sums = fold(part, added)
            slope = slope + RIDGE * w
            if np.abs(slope).max() < 1e-8:
                break
            mixed = sums[: 2 * SIDE + 1].T @ bends @ sums[2 * SIDE + 1 :]
            move = -np.linalg.solve(square - mixed - mixed.T + RIDGE * np.eye(len(w)), slope)
            before, size = counts.loss() + RIDGE / 2 * w @ w, 1.0
            while size > 1e-6:
                tried = w + size * move
                after = counted(tried)
                if after.loss() + RIDGE / 2 * tried @ tried <= before + 1e-4 * size * (slope @ move) + 1e-8:
                    break
                size /= 2
            else:
                break
            w, counts = tried, after
        return w

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([z, *[np.maximum(0.0, z - k) for k in self.knots]])

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Scores before the threshold, the same for equal rows wherever they stand."""
        return (self.expand(x) * (self.weights if weights is None else weights)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return sigmoid(self.raw(x) - self.threshold)


WIDTH = len(features(""))


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, WIDTH)


def featured(docs: DataFrame) -> DataFrame:
    """id, held_out, x (features as doubles) of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        x = [np.array(features(t), float).tobytes() for t in batch.column("text").to_pylist()]
        return {"id": batch.column("id"), "held_out": batch.column("held_out"), "x": pa.array(x, pa.binary())}

    return map_batches(spread(text_rows(docs)).withColumn("held_out", held_out("id", 3, 1)), run, "id long, held_out boolean, x binary")


def folding(blocks: DataFrame, n_blocks: int) -> Fold:
    """Passes over blocks (cell, good, x); results meet in order of their cells, ``FAN`` at a time."""

    def fold(part: Callable, merge: Callable):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell, good, x in zip(*[batch.column(c).to_pylist() for c in ("cell", "good", "x")]):
                    made = pickle.dumps(part(unpacked(x), np.frombuffer(good, bool)))
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int64()), "made": pa.array([made], pa.binary())})

        def merged(parts: pa.Table) -> bytes | None:
            found = None
            for made in parts.sort_by("cell").column("made").to_pylist():
                found = pickle.loads(made) if found is None else merge(found, pickle.loads(made))
            return found

        def meet(key: tuple, parts: pa.Table) -> pa.Table:
            return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "made": pa.array([pickle.dumps(merged(parts))], pa.binary())})

        made, left = blocks.mapInArrow(run, "cell long, made binary"), n_blocks
        while left > 1:
            made, left = made.groupBy(F.floor(F.col("cell") / FAN).alias("above")).applyInArrow(meet, "cell long, made binary"), -(-left // FAN)
        return merged(made.toArrow())

    return fold


def learn(rows: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> Ranker:
    """Train on all labelled rows of ``featured`` that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)).select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("label")).distinct()
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    n_blocks = total // block_rows + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, members in zip(batch.column("cell").to_pylist(), batch.column("members").to_pylist()):
                good, x = np.array([m["label"] == 1 for m in members]), b"".join([m["x"] for m in members])
                yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int64()), "good": pa.array([good.tobytes()], pa.binary()), "x": pa.array([x], pa.binary())})

    known = rows.where(F.col("id").isNotNull() & ~F.col("held_out")).select("id", "x").distinct()
    dealt = known.join(usable, F.col("id") == F.col("label_id")).withColumn("cell", F.pmod(F.xxhash64("id", "label", "x"), F.lit(n_blocks)))
    cells = dealt.repartition(n_blocks, "cell").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("id", "label", "x"))).alias("members"))
    with scratch(rows.sparkSession):
        blocks = materialize(cells.mapInArrow(pack, "cell long, good binary, x binary"), "quality-blocks")
        return Ranker.over(folding(blocks, n_blocks), counts.get(1, 0) / total if total else 0.5)


def fit(docs: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> Ranker:
    """``learn`` from texts."""
    with scratch(docs.sparkSession):
        return learn(materialize(featured(docs), "quality-features"), labels, block_rows)


def score_rows(rows: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``featured``."""
    sent = rows.sparkSession.sparkContext.broadcast(ranker)

    def run(batch: pa.RecordBatch) -> dict:
        s = sent.value.score(unpacked(b"".join(batch.column("x").to_pylist())))
        return {"doc_id": batch.column("id"), "held_out": batch.column("held_out"), "score": s, "predicted": pa.array((s >= 0.5).astype(np.int32))}

    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``score_rows`` of texts."""
    return score_rows(featured(docs), ranker)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(featured(read_table(spark, sf_dir, "documents")), "quality-features", outlive=True)
    return score_rows(rows, learn(rows, read_table(spark, sf_dir, "labels")))
