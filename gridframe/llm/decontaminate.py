"""Benchmark decontamination by canonical templates.

Words become templates: a number is a typed placeholder (with its unit, if one
follows), a run of names is another, every other word is itself in lower case. Names are
listed given names in any case, and other words by their capital. A text is
read up to three times: as it stands; with a capitalised word at a sentence's start as a
name if it is one elsewhere in the text; and without regard to case, where names are
plain words, so a copy in other case is found as well. Further readings add only the
windows that differ. In sentences without a capital names cannot be seen; there any word may
stand where a window of the benchmark has a name (its windows are hashed once for each
pattern of name places that the benchmark has), and slot consistency decides.

Windows of template words are hashed; windows of documents meet those of benchmark items
in a hash join. Windows on neighbouring diagonals (place in the document less place in the
item, differing by up to half of the item's windows) form an alignment, so words may be
inserted or left out. Its slots must be consistent: a value of the item stands for one
value of the document throughout. Which one is settled by the number of windows that
say so, and the windows that agree count. So a question whose numbers and names were
exchanged is found, and a text that only shares the template by chance is not.

Items under ``MIN_WORDS`` template words match by the exact run of all their words, in any
case, without slots; under ``MIN_RUN`` words, only documents that have no other words, as
such an item is part of any text.

A document is contaminated by an item if the windows of a consistent alignment hold at
least ``min_coverage`` of the item's template words, so one word put in or exchanged
costs that word and not all windows around it. One window alone counts only with its own
values, as many sentences share a short template. Items of the same template and pattern of slots
are one class, which is reported under its smallest id with the number of its items. A
benchmark of up to ``BROADCAST_WINDOWS`` windows is broadcast; of a larger one the windows
of each document, thinned by a bitmap of fixed size, meet it in a shuffle. Documents are
read once in either case.

Defined results: null and empty texts, on either side, and texts without a letter or digit match
nothing; items shorter than a window are one window of all their words; rows with null ids match
nothing; repeated items count in their class; repeated rows of a document give one row;
of tied alignments the one with fewer exchanged slots is reported; very long texts are
read whole; extra columns of any name are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, read_table, slices, spread, text_rows

#: Template words of a window, least words of an item, least share of an item's words.
WINDOW = 8
MIN_WORDS = 6
#: Words of an item that are looked for inside of documents.
MIN_RUN = 3
MIN_COVERAGE = 0.6
#: Benchmark windows that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Leading bits of a window's hash in the bitmap that thins documents before the shuffle.
BITMAP_BITS = 26
#: Words that a worker remembers before it starts anew, and bytes of text that it reads at once (a single text may hold more).
MAX_WORDS = 100_000
READ_BYTES = 1 << 20

#: Words for numbers, units and common given names (fixed values).
NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split())
UNITS = set("% mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years km/h mph m/s cent cents dollar dollars euro euros usd eur percent degree degrees °c °f k w kw mw v hz khz mhz ghz kb mb gb tb j kj cal kcal pa kpa".split())
NAMES = set("alice bob carol charlie dave david emma eve frank grace henry jack james jane jill john julia kate laura liam lily linda lucy maria mark mary mia michael natalia noah oliver olivia paul peter sam sarah sophia susan tim tom weng william".split())

NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:st|nd|rd|th)?(%|°?[A-Za-z/]+)?")
PLAIN, NUM, UNIT, NAME, CAPITAL = 0, 1, 2, 3, 4
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Hash of each placeholder (any fixed numbers).
SLOT = {NUM: 0x1B873593CC9E2D51, UNIT: 0x85EBCA6BC2B2AE35, NAME: 0x27D4EB2F165667C5}


class Templates:
    """Template words of texts; remembers what it has seen of each word, packed."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.kind, self.hash, self.ends, self.value = array("b", [PLAIN]), array("Q", [0]), bytearray(1), [""]

    def number(self, word: str) -> int:
        """Entry of a word; 0 if it has no letter or digit."""
        import xxhash

        core = word.strip("\"'“”‘’«»()[]{}<>.,;:!?…—–-*#&|_~`=")
        if word[-1:] == "%" and core[-1:].isdigit():
            core += "%"
        if not any(map(str.isalnum, core)):
            return 0
        low = core.lower()
        match = NUMBER.fullmatch(core)
        if match and (match[1] is None or match[1].lower() in UNITS) or low in NUMBER_WORDS:
            kind = NUM
            value = f"{low}"
        elif low in UNITS:
            kind, value = UNIT, low
        elif low in NAMES:
            kind, value = NAME, low
        else:
            kind, value = (CAPITAL if core[0].isupper() and not core.isupper() else PLAIN), low
        self.kind.append(kind)
        self.hash.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.ends.append(word.rstrip("\"'”’»)]}*#&%$|")[-1:] in (".", "!", "?", "…", ":", "|"))
        self.value.append(word if value == word else value)  # one string where both are the same
        return len(self.kind) - 1

    def readings(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text number, hash, slot?, entry of the word, place in the text, other than in the first?) of each template word, in order.

        The first reading takes unknown words at a sentence's start as plain words. If some of
        them are names elsewhere in their text, more often than they are lower-case words, a
        second reading of those texts has them as names. A last one of texts with names has
        all names as plain words. Places count all words of a text.
        """
        words = self.words(texts)
        text, entry = words[:2]
        if not len(entry):
            return [(text, np.zeros(0, np.uint64), np.zeros(0, bool), entry, text, np.zeros(0, bool))]
        _, _, raw, lower, before, after_end, place = words
        first = (raw == CAPITAL) & after_end
        kind = np.where(raw == CAPITAL, np.where(after_end, PLAIN, NAME), raw)
        none = np.zeros(len(kind), bool)

        def reading(some: np.ndarray, kind: np.ndarray, apart: np.ndarray, other: np.ndarray) -> tuple:
            kind = kind[some]
            keep, hashes = self.template(kind, lower[some], before[some], apart[some])
            return text[some][keep], hashes[keep], ((kind == NUM) | (kind == NAME))[keep], entry[some][keep], place[some][keep], other[some][keep]

        def of_texts(words: np.ndarray) -> np.ndarray:
            has = np.zeros(len(texts), bool)
            has[text[words]] = True
            return has[text]

        out = [reading(~none, kind, none, none)]
        promoted = first & self.names_elsewhere(text, lower, raw, first)
        if promoted.any():
            out.append(reading(of_texts(promoted), np.where(promoted, NAME, kind), promoted, promoted))
        named = kind == NAME
        if named.any():
            out.append(reading(of_texts(named), np.where(named, PLAIN, kind), none, named))
        return out

    def words(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text number, entry, kind, hash, does its text go on?, does it start a sentence?, place in the text) of each word."""
        parts = [t.split() for t in texts]
        all_words = set().union(*parts)
        new = all_words.difference(self.known)
        if new and len(self.known) > MAX_WORDS:  # texts that are read again bring none
            self.forget()
            new = all_words
        known = self.known
        for word in new:
            known[word] = self.number(word)
        sizes = np.array([len(p) for p in parts])
        entry = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        text, entry = text[entry > 0], entry[entry > 0]
        before = np.concatenate(([False], text[1:] == text[:-1]))[: len(text)]
        after_end = np.concatenate(([True], np.frombuffer(self.ends, bool)[entry][:-1]))[: len(text)] | ~before
        place = np.arange(len(text)) - np.flatnonzero(~before)[text_runs(before)]
        return text, entry, np.frombuffer(self.kind, np.int8)[entry], np.frombuffer(self.hash, np.uint64)[entry], before, after_end, place

    def case_free(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text number, hash, kind, entry, place, in a sentence without capitals?) of each template word."""
        text, entry, raw, lower, before, after_end, place = self.words(texts)
        sentence = np.cumsum(after_end) - 1
        free = (np.bincount(sentence, raw == CAPITAL) == 0)[sentence] if len(text) else np.zeros(0, bool)
        keep, hashes = self.template(raw, lower, before, np.zeros(len(text), bool)) if len(text) else (free, lower)
        return text[keep], hashes[keep], raw[keep], entry[keep], place[keep], free[keep]

    @staticmethod
    def template(kind: np.ndarray, lower: np.ndarray, before: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kept?, hash) of each word; a word in ``apart`` starts a sentence and does not join the name before."""
        last = np.concatenate(([PLAIN], kind[:-1]))
        unit_after = (kind == UNIT) & before & (last == NUM)
        name_after = (kind == NAME) & before & (last == NAME) & ~apart
        hashes = lower.copy()
        for k, h in SLOT.items():
            if k != UNIT:
                hashes[kind == k] = h
        return ~(unit_after | name_after), hashes

    @staticmethod
    def names_elsewhere(text: np.ndarray, lower: np.ndarray, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """True for words that are capitals inside sentences of their text more often than lower-case words."""
        key = lower ^ (text.astype(np.uint64) + np.uint64(1)) * BASE
        inside = (raw == CAPITAL) & ~first
        asked = np.intersect1d(key[first], key[inside])
        if not len(asked):
            return np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
        met = asked[at] == key
        names = np.bincount(at[met & inside], minlength=len(asked))
        words = np.bincount(at[met & (raw == PLAIN)], minlength=len(asked))
        return met & (names > words)[at]


def text_runs(before: np.ndarray) -> np.ndarray:
    """Number of the run, of words of one text, that each word is in."""
    return np.cumsum(~before) - 1


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * BASE + hashes[k : k + n]
    return out ^ (out >> np.uint64(29))


#: Windows of a reading: words of each (negative: of words as they are), number of windows, and their places, hashes, slot values and places of names as bits.
READING = "struct<size: int, total: int, places: array<int>, hashes: array<long>, slots: array<array<string>>, masks: array<int>>"


def item_readings(templates: Templates, text: str, window: int) -> list[dict]:
    """Readings of an item that have enough words; the run of its words for an item that has none."""
    out = []
    for _, hashes, slots, entry, places, _ in templates.readings([text]):
        if len(hashes) < MIN_WORDS:
            continue
        size = min(window, len(hashes))
        found = window_hashes(hashes, size)
        values = [[templates.value[e] for e in entry[k : k + size][slots[k : k + size]]] for k in range(len(found))]
        named = hashes == np.uint64(SLOT[NAME])
        masks = [sum(1 << j for j in range(size) if named[k + j]) for k in range(len(found))]
        out.append({"size": size, "total": len(found), "places": places[: len(found)].tolist(), "hashes": found.view(np.int64).tolist(), "slots": values, "masks": masks})
    if not out:
        _, entry, _, lower, _, _, _ = templates.words([text])
        if len(entry):
            out.append({"size": -len(entry), "total": 1, "places": [0], "hashes": window_hashes(lower, len(entry)).view(np.int64).tolist(), "slots": [[]], "masks": [0]})
    return out


def pattern(readings: list[dict]) -> int:
    """Signed hash of templates and of which slots are alike: the same for items that differ in values only."""
    import xxhash

    alike = []
    for r in readings:
        order: dict[str, int] = {}
        alike.append((r["size"], r["hashes"], [[order.setdefault(v, len(order)) for v in slots] for slots in r["slots"]]))
    return xxhash.xxh64_intdigest(repr(alike)) - (1 << 63)


def item_classes(benchmark: DataFrame, window: int) -> DataFrame:
    """(class, item_id, n_items, readings) of items that differ in slot values only."""

    def run(batch: pa.RecordBatch) -> dict:
        templates, ids, keys, found = Templates(), [], [], []
        for item_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            readings = item_readings(templates, text, window)
            if readings:
                ids.append(item_id)
                keys.append(pattern(readings))
                found.append(readings)
        return {"id": ids, "class": keys, "readings": found}

    rows = text_rows(benchmark, "item_id").where("id is not null and text <> ''")
    items = map_batches(rows, run, f"id long, class long, readings array<{READING}>")
    least = F.min_by("readings", "id").alias("readings")
    return items.groupBy("class").agg(F.min("id").alias("item_id"), F.count("*").alias("n_items"), least)


class Benchmark:
    """Windows of the classes, by size and hash."""

    def __init__(self, rows: list):
        table = defaultdict(lambda: defaultdict(list))
        self.masks = defaultdict(set)
        self.classes: list[tuple[int, int, int]] = []  # item, items, windows of a reading
        self.window: list[int] = []
        for row in rows:
            for reading in row["readings"]:
                number = len(self.classes)
                self.classes.append((row["item_id"], row["n_items"], reading["total"]))
                self.window.append(abs(reading["size"]))
                self.masks[reading["size"]].update(m for m in reading["masks"] if m)
                for k, (place, h, slots) in enumerate(zip(reading["places"], reading["hashes"], reading["slots"])):
                    table[reading["size"]][h & (1 << 64) - 1].append((number, k, place, tuple(slots)))
        self.sizes = {s: (np.array(sorted(t), np.uint64), dict(t)) for s, t in table.items()}
        self.masks = {s: sorted(m) for s, m in self.masks.items()}
        self.maybe = {}
        for s, (hashes, _) in self.sizes.items():
            self.maybe[s] = np.zeros(1 << 20, bool)
            self.maybe[s][hashes >> np.uint64(44)] = True

    def matches(self, templates: Templates, texts: list[str], min_coverage: float) -> Iterator[tuple]:
        """(text number, class number, share of words, windows matched, slots exchanged) of best consistent alignments with enough words."""
        hits = defaultdict(list)
        for size, (known, table) in self.sizes.items():
            for text, p, place, h, mine in text_windows(templates, texts, size, lambda found: self.maybe[size][found >> np.uint64(44)], known, self.masks[size]):
                for number, k, item_place, theirs in table[h]:
                    hits[text, number].append((k, item_place, place, theirs, mine))
        for (text, number), found in hits.items():
            best = best_alignment(found, self.window[number], self.classes[number][2], min_coverage)
            if best:
                yield text, number, *best


def text_windows(templates: Templates, texts: list[str], size: int, maybe, known: np.ndarray | None = None, masks: list[int] = ()) -> Iterator[tuple]:
    """(text number, first template word, its place, hash, slot values) of the windows that may be in the benchmark.

    ``masks`` are the places of names in its windows, at which words of sentences without capitals may be names.
    """
    if size < 0:
        yield from word_runs(templates, texts, -size, maybe, known)
        return
    for n, (text, hashes, slots, entry, places, other) in enumerate(templates.readings(texts)):
        found = window_hashes(hashes, size)
        if not len(found):
            continue
        own = text[: len(found)] == text[size - 1 :]
        if n:  # other windows are as in the first reading
            changed = np.concatenate(([0], np.cumsum(other)))
            own &= changed[size:] > changed[: len(found)]
        at = np.flatnonzero(own & maybe(found))
        if known is not None:
            at = at[np.isin(found[at], known)]
        for p in at.tolist():
            yield int(text[p]), p, int(places[p]), int(found[p]), tuple(templates.value[e] for e in entry[p : p + size][slots[p : p + size]])


    if not masks:
        return
    text, hashes, kind, entry, places, free = templates.case_free(texts)
    n = len(text) - size + 1
    if n <= 0:
        return
    sums = np.concatenate(([0], np.cumsum(free)))
    start = np.flatnonzero((sums[size:] - sums[:n] == size) & (text[:n] == text[size - 1 :]))
    for mask in masks if len(start) else ():
        found, fits = np.zeros(len(start), np.uint64), np.ones(len(start), bool)
        for k in range(size):
            if mask >> k & 1:
                found = found * BASE + np.uint64(SLOT[NAME])
                fits &= (kind[start + k] == PLAIN) | (kind[start + k] == NAME)
            else:
                found = found * BASE + hashes[start + k]
        found ^= found >> np.uint64(29)
        at = np.flatnonzero(fits & maybe(found))
        if known is not None:
            at = at[np.isin(found[at], known)]
        for j in at.tolist():
            p = int(start[j])
            yield int(text[p]), p, int(places[p]), int(found[j]), tuple(templates.value[entry[p + k]] for k in range(size) if mask >> k & 1 or kind[p + k] in (NUM, NAME))


def word_runs(templates: Templates, texts: list[str], size: int, maybe, known: np.ndarray | None) -> Iterator[tuple]:
    """As ``text_windows``, for runs of ``size`` words as they are; under MIN_RUN words, whole texts only."""
    text, _, _, lower, before, _, places = templates.words(texts)
    found = window_hashes(lower, size)
    own = text[: len(found)] == text[size - 1 :]
    if size < MIN_RUN:
        goes_on = np.concatenate((before[1:], [False]))
        own &= ~before[: len(found)] & ~goes_on[size - 1 :]
    at = np.flatnonzero(own & maybe(found)) if len(found) else np.zeros(0, np.int64)
    if known is not None:
        at = at[np.isin(found[at], known)]
    for p in at.tolist():
        yield int(text[p]), p, int(places[p]), int(found[p]), ()


def words_in(windows: set[int], size: int) -> int:
    """Words in the union of windows that start at these places."""
    end = count = 0
    for k in sorted(windows):
        count += k + size - max(k, end)
        end = k + size
    return count


def best_alignment(hits: list[tuple], size: int, total: int, min_coverage: float) -> tuple[float, int, int] | None:
    """(share of words, windows matched, slots exchanged) of the best alignment of hits (k, item place, place, item's slots, document's)."""
    n_words = total + size - 1
    least = min_coverage * n_words
    if words_in({h[0] for h in hits}, size) < least:
        return None
    diagonals = defaultdict(list)
    for hit in hits:
        diagonals[hit[2] - hit[1]].append(hit)
    band, order = max(WINDOW, total // 2), sorted(diagonals)
    best, end = None, 0
    for start in range(len(order)):
        reached, end = end, max(end, start + 1)
        while end < len(order) and order[end] - order[start] <= band:
            end += 1
        near = order[start:end]
        if end > reached and words_in({h[0] for d in near for h in diagonals[d]}, size) >= least:  # not inside the band before
            windows, exchanged = aligned([h for d in near for h in diagonals[d]])
            if len(windows) < 2 and exchanged:
                continue
            found = (words_in(windows, size), len(windows), -exchanged)
            best = max(best, found) if best else found
    return (best[0] / n_words, best[1], -best[2]) if best and best[0] >= least else None


def aligned(hits: list[tuple]) -> tuple[set[int], int]:
    """(windows matched, number of slots exchanged) of a consistent alignment.

    Slots are settled first, those that most windows agree on before others. Then windows of
    the item are taken in order, each at a later place than the one before, on the diagonal
    next to that one's if several have it.
    """
    votes: Counter = Counter()
    for k, pair in {(h[0], pair) for h in hits for pair in zip(h[3], h[4])}:
        votes[pair] += 1
    stands: dict[str, str] = {}
    taken: set[str] = set()
    for (a, b), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0][0] != v[0][1], v[0])):
        if a not in stands and b not in taken:
            stands[a] = b
            taken.add(b)
    having = defaultdict(list)
    for k, item_place, place, theirs, mine in hits:
        if all(stands.get(a) == b for a, b in zip(theirs, mine)):
            having[k].append((place - item_place, place, theirs))
    windows, diagonal, last, used = set(), None, -1, set()
    for k in sorted(having):
        later = [h for h in having[k] if h[1] > last]
        if later:
            diagonal, last, theirs = min(later, key=lambda h: (0 if diagonal is None else abs(h[0] - diagonal), h[0]))
            windows.add(k)
            used.update(theirs)
    return windows, sum(a != stands[a] for a in used)


FOUND = "doc_id long, item_id long, n_items long, n_matched int, n_windows int, coverage double, n_exchanged int"


def found_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (doc_id, item_id, n_items, n_windows, coverage, n_matched, n_exchanged)."""
    doc_ids, items, n_items, total, coverage, matched, exchanged = zip(*rows) if rows else [()] * 7
    ints = lambda x: pa.array(x, pa.int32())
    cols = [pa.array(doc_ids, pa.int64()), pa.array(items, pa.int64()), pa.array(n_items, pa.int64()), ints(matched), ints(total), pa.array(coverage, pa.float64()), ints(exchanged)]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in FOUND.split(", ")])


def found_by_broadcast(rows: DataFrame, classes: DataFrame, min_coverage: float) -> DataFrame:
    """Alignments where every task holds the benchmark, whose size was checked."""
    sent = rows.sparkSession.sparkContext.broadcast(Benchmark(classes.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, bench = Templates(), sent.value
        for whole in batches:
            for batch in slices(whole, READ_BYTES):
                ids = batch.column("id").to_pylist()
                got = [(ids[d], *bench.classes[c], *best) for d, c, *best in bench.matches(templates, batch.column("text").to_pylist(), min_coverage)]
                if got:
                    yield found_rows(got)

    return rows.mapInArrow(run, FOUND)


def hash_bitmap(windows: DataFrame) -> np.ndarray:
    """Which leading bits of hashes occur: 2^BITMAP_BITS bits, whatever the benchmark."""
    lead = F.shiftrightunsigned("hash", 64 - BITMAP_BITS) + 1  # the functions count from 1
    rows = windows.groupBy(F.bitmap_bucket_number(lead).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(lead)).alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows:
        first = (r["b"] - 1) * 4096  # bytes of a bucket
        out[first : first + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def found_by_shuffle(rows: DataFrame, classes: DataFrame, min_coverage: float) -> DataFrame:
    """Alignments where windows meet by their hash."""
    one = classes.select("class", "item_id", "n_items", F.posexplode("readings").alias("reading", "r"))
    cut = one.select("class", "reading", "item_id", "n_items", F.col("r.size").alias("size"), F.col("r.total").alias("total"), F.posexplode(F.arrays_zip("r.places", "r.hashes", "r.slots", "r.masks")).alias("k", "w"))
    windows = materialize(cut.select("class", "reading", "item_id", "n_items", "size", "total", "k", F.col("w.places").alias("item_place"), F.col("w.hashes").alias("hash"), F.col("w.slots").alias("theirs"), F.col("w.masks").alias("mask")), "leak-items")
    sizes: dict[int, list[int]] = defaultdict(list)  # up to MIN_WORDS + WINDOW different ones, with 2^WINDOW masks at most
    for r in windows.groupBy("size", "mask").count().orderBy("size", "mask").collect():
        sizes[r["size"]] += [r["mask"]] if r["mask"] else []
    sent = rows.sparkSession.sparkContext.broadcast(hash_bitmap(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, bits = Templates(), sent.value

        def maybe(found: np.ndarray) -> np.ndarray:
            lead = found >> np.uint64(64 - BITMAP_BITS)
            return (bits[(lead >> np.uint64(3)).astype(np.int64)] >> (lead & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for whole in batches:
            for batch in slices(whole, READ_BYTES):
                ids, keys, texts = (batch.column(c).to_pylist() for c in ("id", "key", "text"))
                for size, masks in sizes.items():
                    got = [(ids[d], keys[d], size, place, h - (1 << 64) if h >> 63 else h, mine) for d, _, place, h, mine in text_windows(templates, texts, size, maybe, None, masks)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["id", "key", "d_size", "place", "d_hash", "mine"])

    mine = rows.withColumn("key", F.xxhash64("text")).mapInArrow(run, "id long, key long, d_size int, place int, d_hash long, mine array<string>")
    met = mine.join(windows.drop("mask"), (F.col("d_hash") == F.col("hash")) & (F.col("d_size") == F.col("size")))
    hit = F.struct("k", "item_place", "place", "theirs", "mine")
    groups = met.groupBy("id", "key", "class", "reading", "item_id", "n_items", "size", "total").agg(F.collect_set(hit).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                best = best_alignment([(h["k"], h["item_place"], h["place"], tuple(h["theirs"]), tuple(h["mine"])) for h in r["hits"]], abs(r["size"]), r["total"], min_coverage)
                if best:
                    out.append((r["id"], r["item_id"], r["n_items"], r["total"], *best))
            yield found_rows(out)

    return groups.mapInArrow(judge, FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document and class of benchmark items in it."""
    classes = materialize(item_classes(benchmark, window), "leak-classes")
    size = F.aggregate("readings", F.lit(0).cast("long"), lambda n, r: n + r["total"])
    n_windows = classes.agg(F.sum(size)).first()[0] or 0
    rows = spread(text_rows(docs).where("id is not null and text <> ''"))
    found = (found_by_broadcast if n_windows <= broadcast_windows else found_by_shuffle)(rows, classes, min_coverage)
    best = F.max(F.struct("coverage", "n_matched", (-F.col("n_exchanged")).alias("fewer"), "n_windows", "n_items")).alias("b")
    best = found.groupBy("doc_id", "item_id").agg(best)
    return best.select("doc_id", "item_id", "b.n_items", "b.n_matched", "b.n_windows", "b.coverage", (-F.col("b.fewer")).alias("n_exchanged"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; all columns as they were. Each row goes by its text, whatever its id."""
    key = F.xxhash64(docs["text"])
    bad = find_leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__leak_key")).distinct()
    return docs.join(bad, key == F.col("__leak_key"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
