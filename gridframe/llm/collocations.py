"""Phrase collocations from compressed position bitmaps.

A shard is some texts of one language on a row of positions, a free place between two
pieces. Each word has a bitmap of its positions, kept as (block, mask) entries of its
non-empty blocks. A phrase's bitmap (of its last words) is shifted by one place and met
block by block with the bitmaps of all words there: AND gives the longer phrases' bitmaps,
popcounts their occurrences. No phrase crosses a piece, as nothing stands on a free place.
Phrases grow depth first, from some first words at a time, so what a worker holds is
bounded by a shard. Counts are summed over shards by a shuffle.

Phrases of one length are counted a pass. A phrase can only be frequent if its parts are;
frequent phrases of each length are therefore marked in a bit table of fixed size
(``FILTER_BITS``, several hashes), which is broadcast to the next pass and keeps most others from being
counted at all. A wrong hit in it costs one counted phrase more and changes no result: the
threshold is applied to the exact sums.

Defined results: null texts are empty, a null language is ``und``; only A-Z is lowered; words
are what stands between blanks and tabs; ties go by count, then phrase in UTF-8 order;
repeated rows count as often as they occur; extra columns of any name are left aside; very
long texts are read whole (a shard is cut between pieces, never within one); an empty table
gives an empty result. Counts up to 10^16 are exact.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, spread

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: A longer candidate with this share of a phrase's occurrences takes its place, in hundredths.
ABSORB = 50
#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20
#: Bits of the table of frequent phrases (16 MB) and hashes for each phrase.
FILTER_BITS, HASHES = 1 << 27, 3
#: Entries that phrases are met with at once.
STEP = 1 << 20
#: Positions in a block of a bitmap.
WIDTH = 8
FULL = (1 << WIDTH) - 1
#: Piece ends (fixed by the contract) become this byte, which no UTF-8 text has.
GAP = b"\xff"
ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_TO_GAP = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---------------------------------------------------------------- frequent phrases as bits


#: Bits that a phrase's hash is turned by before its next word's comes in.
TURN = 21


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on by one word."""
    return (hashes << np.uint64(TURN) | hashes >> np.uint64(64 - TURN)) ^ words


class BitTable:
    """Membership of phrases by their hashes, with a few wrong hits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashed: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashed), bool)
        for k in range(HASHES):
            bit = (hashed >> np.uint64(k * 18)) & np.uint64(FILTER_BITS - 1)
            found &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def bit_table(frequent: DataFrame) -> BitTable:
    """Bits of ``frequent`` (lang, phrase), or-ed together before they leave the executors: at most FILTER_BITS / 64 rows come back."""
    of_word = lambda w: F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), w.cast("binary")))
    turned = lambda h: F.shiftleft(h, TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN))
    hashed = F.aggregate(F.split("phrase", " "), F.lit(0).cast("long"), lambda h, w: turned(h).bitwiseXOR(of_word(w)))
    bits = frequent.select(hashed.alias("h")).select(F.explode(F.array(*[F.shiftrightunsigned("h", k * 18).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(HASHES)])).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return BitTable(out)


# ---------------------------------------------------------------- a shard's bitmaps


class Shard:
    """Words of a shard and the bitmaps of their positions."""

    def __init__(self, lang: bytes, texts: list[bytes]):
        data = GAP.join(texts).translate(_TO_GAP).replace(GAP, b" " + GAP + b" ")
        ids: dict[bytes, int] = defaultdict(count().__next__)
        gap = ids[GAP]
        tokens = data.replace(b"\t", b" ").split(b" ")
        blank = ids[b""]
        at = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
        del tokens, data
        self.lang, self.ids = lang, at[at != blank]
        self.words = pa.array(list(ids), pa.binary())
        self.counts = np.bincount(self.ids, minlength=len(ids))
        self.counts[[gap, blank]] = 0
        self.live = self.counts > 0

    def only(self, table: BitTable) -> None:
        """Leave out the words that are not frequent."""
        import xxhash

        own = np.flatnonzero(self.live)
        of, lang = xxhash.xxh64_intdigest, self.lang + b"\0"
        hashed = np.array([of(lang + w, 42) for w in self.words.take(pa.array(own)).to_pylist()], np.uint64)
        self.hashes = np.zeros(len(self.live), np.uint64)
        self.hashes[own] = hashed
        self.live[own] = table.has(hashed)

    def index(self) -> None:
        """Entries (word, block, mask) of every word, block by block, and where each block's begin."""
        places = np.flatnonzero(self.live[self.ids])
        word, block, mask = self.ids[places], places // WIDTH, (1 << (places % WIDTH)).astype(np.uint8)
        # a word's bits of one block are one entry; neighbours in it are met here, others stay apart, as their bits are
        first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])))) if len(word) else places
        self.word, self.block = word[first], block[first]
        self.mask = np.bitwise_or.reduceat(mask, first) if len(first) else mask
        self.starts = np.searchsorted(self.block, np.arange(len(self.ids) // WIDTH + 3))

    def extend(self, node: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, word, block, mask): bitmaps of the phrases one word longer than those of the entries given."""
        wide = mask.astype(np.uint16) << 1
        stay, over = (wide & FULL).astype(np.uint8), (wide >> WIDTH).astype(np.uint8)
        one, two = np.flatnonzero(stay), np.flatnonzero(over)
        node, block, mask = np.concatenate((node[one], node[two])), np.concatenate((block[one], block[two] + 1)), np.concatenate((stay[one], over[two]))
        begin = self.starts[block]
        size = self.starts[block + 1] - begin
        after = np.cumsum(size)
        with_ = np.repeat(begin - (after - size), size) + np.arange(after[-1] if len(after) else 0)
        both = self.mask[with_] & np.repeat(mask, size)
        hit = np.flatnonzero(both)
        which = np.repeat(np.arange(len(size)), size)[hit]
        return node[which], self.word[with_[hit]], block[which], both[hit]


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys sorted, and where each stood; equal ones as they came. Sorting numbers is faster than sorting places, so places ride in the low bits."""
    bits = max(1, len(keys)).bit_length()
    if len(keys) and int(keys.max()) >> (63 - bits):
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    packed = np.sort(keys.astype(np.int64) << bits | np.arange(len(keys)))
    return packed >> bits, packed & ((1 << bits) - 1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the number of each key among them."""
    ordered, order = in_order(keys)
    new = np.concatenate((np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def cut_steps(block_sizes: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Runs of first words whose entries meet about ``step`` others together."""
    total = np.concatenate(([0], np.cumsum(block_sizes)))
    at = 0
    while at < len(block_sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + step, side="right")) - 1)
        yield at, end
        at = end


def phrase_counts(shard: Shard, length: int, tables: list[BitTable], step: int = STEP) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, occurrences in the shard) of ``length`` words all of whose shorter parts are in ``tables``."""
    shard.only(tables[0])
    shard.index()
    ordered, order = in_order(shard.word)
    at_word = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), ordered[1:] != ordered[:-1])))
    words = ordered[at_word]
    ends = np.concatenate((at_word[1:], [len(order)])) if len(words) else at_word
    near = shard.starts[shard.block + 1] - shard.starts[shard.block] + 1
    weights = np.add.reduceat(near[order], at_word) if len(words) else near[:0]
    for a, b in cut_steps(weights, step):
        entries = order[at_word[a] : ends[b - 1]]
        last, hashes = words[a:b, None], shard.hashes[words[a:b]]  # the words of each phrase, and its hash
        node, block, mask = np.searchsorted(words[a:b], shard.word[entries]), shard.block[entries], shard.mask[entries]
        for depth in range(2, length + 1):
            node, word, block, mask = shard.extend(node, block, mask)
            keys = node * np.int64(len(shard.words)) + word
            found, place = distinct(keys)
            parents, added = found // len(shard.words), (found % len(shard.words)).astype(np.int32)
            last = np.column_stack((last[parents], added)) if len(found) else np.zeros((0, depth), np.int32)
            hashes = longer(hashes[parents], shard.hashes[added])
            keep = np.ones(len(found), bool)
            if depth < length:
                keep = tables[depth - 1].has(hashes)
            elif depth > 2:  # the phrase without its first word
                tail = shard.hashes[last[:, 1]]
                for k in range(2, depth):
                    tail = longer(tail, shard.hashes[last[:, k]])
                keep = tables[depth - 2].has(tail)
            if depth == length:
                sums = np.bincount(place, weights=np.bitwise_count(mask), minlength=len(found)).astype(np.int64)
                chosen = np.flatnonzero(keep)
                if len(chosen):
                    texts = [shard.words.take(pa.array(last[chosen, k])) for k in range(length)]
                    yield pc.binary_join_element_wise(*texts, b" "), sums[chosen]
                break
            new = np.cumsum(keep) - 1
            kept = np.flatnonzero(keep[place])
            node, block, mask = new[place[kept]], block[kept], mask[kept]
            last, hashes = last[keep], hashes[keep]


# ---------------------------------------------------------------- over all shards


def cut_text(data: bytes, limit: int) -> Iterator[bytes]:
    """Parts of a text of about ``limit`` bytes, cut at piece ends."""
    at = 0
    while len(data) - at > limit:
        m = ENDS.search(data, at + limit)
        if not m:
            break
        yield data[at : m.start()]
        at = m.end()
    yield data[at:]


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Shard]:
    """The texts of a partition as shards of one language each."""
    held: dict[bytes, list[bytes]] = {}
    size = 0
    for whole in batches:
        for batch in slices(whole):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for part in cut_text(text, limit) if len(text) > limit else (text,):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= limit:
                        for k, texts in held.items():
                            yield Shard(k, texts)
                        held, size = {}, 0
    for k, texts in held.items():
        yield Shard(k, texts)


COUNTS = "lang binary, phrase binary, f long"


def _rows(lang: bytes, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.binary()), "phrase": phrases, "f": pa.array(counts, pa.int64())})


def counted(texts: DataFrame, length: int, tables: list, limit: int) -> DataFrame:
    """(lang, phrase, f) of phrases of ``length`` words; ``tables`` are broadcast bit tables of the shorter ones. For words f counts all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t.value for t in tables]
        for shard in shards(batches, limit):
            if length == 1:
                own = np.flatnonzero(shard.live)
                if len(own):
                    yield _rows(shard.lang, shard.words.take(pa.array(own)), shard.counts[own])
                continue
            for phrases, sums in phrase_counts(shard, length, known):
                yield _rows(shard.lang, phrases, sums)

    found = texts.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return found.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f")


def score(a: str, left: str, right: str):
    """floor(1000000 a^2 / (l r)), exact."""
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000), wide(left) * wide(right))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, absorb: int = ABSORB, top: int | None = TOP, shard_bytes: int = SHARD_BYTES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to ``max_words`` words."""
    sc = docs.sparkSession.sparkContext
    texts = spread(docs.select(F.coalesce(F.col(lang_col), F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")))
    words = materialize(counted(texts, 1, [], shard_bytes), "phrases-1")
    totals = words.groupBy(F.col("lang").alias("n_lang")).agg(F.sum("f").alias("n"))
    frequent = [materialize(words.where(F.col("f") >= min_count), "frequent-1")]
    tables: list = []
    for length in range(2, max_words + 1):
        tables.append(sc.broadcast(bit_table(frequent[-1])))
        found = counted(texts, length, tables, shard_bytes).where(F.col("f") >= min_count)
        frequent.append(materialize(found, f"frequent-{length}"))

    cut = lambda start, size: F.concat_ws(" ", F.slice(F.split("phrase", " "), start, size))
    scored = None
    for length in range(2, max_words + 1):
        own = frequent[length - 1].withColumnRenamed("f", "a")
        for k in range(1, length):
            for name, part, start, size in (("l", frequent[k - 1], 1, k), ("r", frequent[length - k - 1], k + 1, length - k)):
                other = part.select(F.col("lang").alias("o_lang"), F.col("phrase").alias("o_phrase"), F.col("f").alias(f"{name}{k}"))
                own = own.join(other, (F.col("lang") == F.col("o_lang")) & (cut(start, size) == F.col("o_phrase"))).drop("o_lang", "o_phrase")
        each = [F.struct(score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, length)]
        own = own.select("lang", "phrase", "a", (F.least(*each) if len(each) > 1 else each[0]).alias("cut"))
        if length < max_words:  # what longer candidates hold most occurrences of
            held = None
            for longer in range(length + 1, max_words + 1):
                inner = F.explode(F.array(*[cut(s, length) for s in range(1, longer - length + 2)]))
                part = frequent[longer - 1].select(F.col("lang").alias("o_lang"), F.col("f").alias("longer"), inner.alias("o_phrase"))
                held = part if held is None else held.unionByName(part)
            held = held.groupBy("o_lang", "o_phrase").agg(F.max("longer").alias("longer"))
            own = own.join(held, (F.col("lang") == F.col("o_lang")) & (F.col("phrase") == F.col("o_phrase")), "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorb)).select("lang", "phrase", "a", "cut")
        scored = own if scored is None else scored.unionByName(own)
    scored = materialize(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "phrases-scored")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if top is not None:  # a language's best are among the best of its parts
        part = Window.partitionBy("lang", "part").orderBy(*best)
        scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("part", "rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    joined = ranked.join(totals, F.col("lang") == F.col("n_lang"))
    return joined.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").withColumn("rank", F.col("rank").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), f1 AS (
  SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM pieces) GROUP BY lang, p
), f2 AS (
  SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM pieces) GROUP BY lang, p HAVING count(*) >= 10
), f3 AS (
  SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS p FROM pieces) GROUP BY lang, p HAVING count(*) >= 10
), n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang
), c2 AS (
  SELECT lang, p, f AS a, split_part(p, ' ', 1) AS x, split_part(p, ' ', 2) AS y FROM f2
), c3 AS (
  SELECT lang, p, f AS a, split_part(p, ' ', 1) AS x, split_part(p, ' ', 2) AS y, split_part(p, ' ', 3) AS z FROM f3
), cuts AS (
  SELECT c2.lang, c2.p, a, 1 AS k, l.f AS l, r.f AS r FROM c2 JOIN f1 l ON l.lang = c2.lang AND l.p = x JOIN f1 r ON r.lang = c2.lang AND r.p = y
  WHERE NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = c2.lang AND (c3.x || ' ' || c3.y = c2.p OR c3.y || ' ' || c3.z = c2.p) AND 100 * c3.a >= 50 * c2.a)
  UNION ALL SELECT c3.lang, c3.p, a, 1, l.f, r.f FROM c3 JOIN f1 l ON l.lang = c3.lang AND l.p = x JOIN f2 r ON r.lang = c3.lang AND r.p = y || ' ' || z
  UNION ALL SELECT c3.lang, c3.p, a, 2, l.f, r.f FROM c3 JOIN f2 l ON l.lang = c3.lang AND l.p = x || ' ' || y JOIN f1 r ON r.lang = c3.lang AND r.p = z
), lowest AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY (1000000::HUGEINT * a * a) // (l::HUGEINT * r), k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM lowest
)
SELECT ranked.lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
