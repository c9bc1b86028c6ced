"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids go together.

A slice of an Arrow batch is aligned at once. The tokens of all its documents lie end to
end on one axis of bytes; A's and B's ends are counted on it together, a place with both is
a cut, and every place with an end closes the overlap of one A and one B token (two
ranges overlap in one range, so no pair is met twice). Sums up to the documents' own ends
give each document's numbers.

The corpus-wide count of an id pair is summed by a shuffle. A second pass over the texts
meets these counts: the table of pairs is bounded by the product of the vocabularies, and
broadcast in blocks of ``MAX_PAIRS`` at most; one block as a rule, more passes beyond it.

Both libraries are asked once for a word, many words at once. That is exact where neither looks across the
white space before a word, which is checked (``word_by_word``); texts with odd white space,
and all texts of tokenizers that do not allow it, go to the libraries whole.

Defined results: a null or empty text has no tokens, nor has one whose tokens of either
side do not join to its bytes; rows with a null id, repeated rows and equal ids are
documents of their own; ties for the highest count are all best; extra columns of any name are left aside;
very long texts are aligned whole, in memory in proportion to one text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, spread

#: Id pairs in a block that is broadcast (16 bytes each).
MAX_PAIRS = 8 << 20
#: Links that a worker counts before it hands its sums on.
FLUSH_LINKS = 4 << 20
#: Words, and token ids of them, that a worker remembers before it starts anew.
MAX_WORDS, MAX_IDS = 1_000_000, 16 << 20
BLANK = "▁"
#: Words, after their blank or line end, that cannot be encoded apart: none, other white space, or B's sign for a blank.
ODD = re.compile(r"\n?+(?:\Z|.*[\s▁])", re.S)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible, else the next beyond U+00FF."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Encoded:
    """Token ids of a slice of documents, end to end, and how many are each document's."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray


class Words(dict):
    """Entry of each word; unknown ones get the next entry, and wait in ``new`` until they are learnt."""

    def __init__(self):
        super().__init__()
        self.next, self.new = 0, []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = self.next
        self.next += 1
        return self.next - 1


class TokenPair:
    """Two tokenizers, the bytes of their tokens, and the words they have seen."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, size = byte_letters(), self.a.get_vocab_size()
        pieces = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(letters[c] for c in p) if all(c in letters for c in p) else p.encode() for p in pieces]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id(BLANK)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.heads_a, self.heads_b = (np.array([x[:1] in (b" ", b"\n") for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.words = self.word_by_word(json.loads(self.a.to_str()), pieces)
        signs = [f"{i}{end}" for i in range(size) for end in ",|"] + [f"{i}{end}" for i in range(len(pieces)) for end in ",;"]
        self.signs = pa.array(signs, pa.large_string())
        self.forget()

    @staticmethod
    def word_by_word(spec: dict, pieces: list[str]) -> bool:
        """Whether words can be encoded apart: A splits before white space by the byte-level rule, no piece of B goes on after its blank or a line end."""
        before = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["model"].get("dropout")
        return bool(plain) and not any(BLANK in p.lstrip(BLANK) or len(p) > 1 and "\n" in p for p in pieces)

    def forget(self) -> None:
        self.known = Words()
        self.pool_a, self.pool_b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        self.n_a, self.n_b, self.bad = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        self.ids = 0

    def ids_of(self, chunks: list[str]) -> tuple[list[int], list[int]]:
        """Ids of the chunks, which begin with a blank or a line end, as one text."""
        text = "".join(chunks)
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text.removeprefix(" "))
        return a, b if text[0] == " " or b[:1] != [self.blank] else b[1:]  # B puts a blank before

    def fits(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of either side join to the bytes of ``text``."""
        return b"".join(map(self.bytes_a.__getitem__, a)) == text.encode("utf-8", "surrogatepass") == b"".join(map(self.bytes_b.__getitem__, b))

    def keep(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, bad: np.ndarray) -> None:
        for held, new in ((self.pool_a, a), (self.n_a, n_a), (self.pool_b, b), (self.n_b, n_b), (self.bad, bad)):
            held.append(new)
        self.ids += len(a) + len(b)

    def learn(self, words: list[str]) -> None:
        """Entries of words, in their order; those of many at once, cut where a token begins with a blank or line end."""
        if not self.words:
            self.keep(*(np.zeros(n, np.int64) for n in (0, len(words), 0, len(words))), np.ones(len(words), bool))
            return
        odd = [bool(ODD.match(w)) for w in words]
        chunks = [" x" if o else w if w.startswith("\n") else " " + w for w, o in zip(words, odd)]
        a, b = self.ids_of(chunks)
        sides = []
        for ids, heads in ((a, self.heads_a), (b, self.heads_b)):
            ids = np.asarray(ids, np.int32)
            first = np.flatnonzero(heads[ids])
            sides += [ids, np.diff(np.append(first, len(ids)))]
        if len(sides[1]) == len(sides[3]) == len(words) and self.fits("".join(chunks), a, b):
            self.keep(*sides, np.array(odd))
        elif len(words) > 1:
            self.learn(words[: len(words) // 2])
            self.learn(words[len(words) // 2 :])
        else:
            self.keep(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64), np.ones(1, bool))

    def learn_whole(self, text: str) -> int:
        """Entry of a whole text, without ids if it does not join to its bytes."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if not self.fits(" " + text, a, b):
            a = b = []
        self.keep(np.array(a, np.int32), np.array([len(a)]), np.array(b, np.int32), np.array([len(b)]), np.zeros(1, bool))
        self.known.next += 1
        return self.known.next - 1

    def encode(self, texts: list[str | None]) -> Encoded:
        """Ids of both sides; none for texts that have no tokens."""
        if len(self.known) > MAX_WORDS or self.ids > MAX_IDS:
            self.forget()
        spaced = [t.replace("\n", " \n") if t else "" for t in texts]
        sizes = np.array([t.count(" ") + 1 if t else 0 for t in spaced], np.int64)
        words = " ".join(filter(None, spaced)).split(" ") if sizes.any() else []
        flat = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for at in range(0, len(self.known.new), 5_000):
            self.learn(self.known.new[at : at + 5_000])
        self.known.new.clear()
        for held in (self.pool_a, self.pool_b, self.n_a, self.n_b, self.bad):
            held[:] = [np.concatenate(held)]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        bad = np.concatenate(([0], np.cumsum(self.bad[0][flat], dtype=np.int64)))[ends]
        whole = np.flatnonzero(np.diff(bad))
        if len(whole):  # one entry in the place of all their words
            parts = np.split(flat, ends[1:-1])
            for k in whole.tolist():
                parts[k] = np.array([self.learn_whole(texts[k])])
            flat, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum(list(map(len, parts)))))
        (a, n_a), (b, n_b) = self.gather(self.pool_a, self.n_a, flat, ends), self.gather(self.pool_b, self.n_b, flat, ends)
        return Encoded(a, n_a, b, n_b)

    @staticmethod
    def gather(pool: list, sizes: list, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries end to end, and their number for each document."""
        if len(pool) > 1:  # whole texts came after
            pool[:], sizes[:] = [np.concatenate(pool)], [np.concatenate(sizes)]
        n = sizes[0][flat]
        after = np.cumsum(n)
        begin = (np.cumsum(sizes[0]) - sizes[0])[flat]
        ids = pool[0][np.repeat(begin - (after - n), n) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.diff(np.concatenate(([0], after))[ends])


class Alignment:
    """Cuts and links of a slice of documents."""

    def __init__(self, pair: TokenPair, texts: list[str | None]):
        self.pair, self.found = pair, pair.encode(texts)
        e = self.found
        ends_a, ends_b = np.cumsum(pair.len_a[e.a]), np.cumsum(pair.len_b[e.b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        ends = np.bincount(np.concatenate((ends_a, ends_b)), minlength=total + 1)
        of_a = np.zeros(total + 1, bool)
        of_a[ends_a] = True
        places = np.flatnonzero(ends)  # the end of each link
        self.cut = ends[places] == 2
        self.is_a = of_a[places]
        self.is_b = self.cut | ~self.is_a
        self.at_a, self.at_b = np.cumsum(self.is_a), np.cumsum(self.is_b)
        last_a = np.cumsum(e.n_a)
        doc_ends = np.concatenate(([0], ends_a))[last_a]
        self.doc_links = np.searchsorted(places, doc_ends, side="right")  # links up to each document's end

    def per_doc(self, sums: np.ndarray) -> np.ndarray:
        """A document's share of running sums over links."""
        return np.diff(np.concatenate(([0], sums))[np.concatenate(([0], self.doc_links))])

    def pairs(self) -> np.ndarray:
        """Each link's ids as one number."""
        a, b = self.found.a[self.at_a - self.is_a], self.found.b[self.at_b - self.is_b]
        return a.astype(np.int64) * len(self.pair.len_b) + b

    def groups(self) -> list[str]:
        """Digest of each document's groups, '' without tokens."""
        e, cut = self.found, self.cut
        group = np.cumsum(cut) - cut
        cuts_a, cuts_b = (np.concatenate(([0], at[cut])) for at in (self.at_a, self.at_b))
        codes = np.empty(len(e.a) + len(e.b), np.int64)
        # A's tokens of a group, then B's
        codes[np.arange(len(e.a)) + cuts_b[group[self.is_a]]] = e.a * np.int64(2) + cut[self.is_a]
        codes[np.arange(len(e.b)) + cuts_a[group[self.is_b] + 1]] = (e.b + np.int64(len(self.pair.len_a))) * 2 + cut[self.is_b]
        signs = self.pair.signs.take(pa.array(codes))
        offsets = np.frombuffer(signs.buffers()[1], np.int64)[signs.offset : signs.offset + len(signs) + 1] if len(signs) else np.zeros(1, np.int64)
        data = memoryview(signs.buffers()[2]) if len(signs) else b""
        ends = offsets[np.concatenate(([0], np.cumsum(e.n_a + e.n_b)))].tolist()
        return [hashlib.sha256(data[start : end - 1]).hexdigest() if end > start else "" for start, end in zip(ends, ends[1:])]


_PAIRS: dict[tuple[str, str], TokenPair] = {}


def token_pair(path_a: str, path_b: str) -> TokenPair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = TokenPair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def link_counts(texts: DataFrame, path_a: str, path_b: str, flush: int = FLUSH_LINKS) -> DataFrame:
    """(pair, links, best): how many links of all ``texts`` hold an id pair, and whether no pair of its B id has more."""
    base = len(token_pair(path_a, path_b).len_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, size = token_pair(path_a, path_b), [], 0

        def sums() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"pair": keys, "links": counts.astype(np.int64)})

        for whole in batches:
            for batch in slices(whole):
                held.append(Alignment(pair, batch.column("text").to_pylist()).pairs())
                size += len(held[-1])
                if size >= flush:
                    yield sums()
                    held, size = [], 0
        if size:
            yield sums()

    counted = texts.select("text").mapInArrow(run, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    counted = materialize(counted, "align-pairs").withColumn("b", F.pmod("pair", F.lit(base)))
    most = counted.groupBy(F.col("b").alias("most_b")).agg(F.max("links").alias("most"))  # a row for each id of B at most
    return counted.join(F.broadcast(most), F.col("b") == F.col("most_b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_OWN = {"id": pa.int64(), "row": pa.int64()}


def measured(rows: DataFrame, path_a: str, path_b: str, counts: DataFrame | None) -> DataFrame:
    """(id, row, numbers, groups_sha256) of ``rows`` (id, row, text); counts of the links whose pair is in ``counts``, which is broadcast."""
    block = None
    if counts is not None:
        table = counts.select("pair", F.when(F.col("best"), -F.col("links")).otherwise(F.col("links")).alias("signed")).toArrow()
        keys, signed = (table.column(n).to_numpy() for n in ("pair", "signed"))
        order = np.argsort(keys)
        block = rows.sparkSession.sparkContext.broadcast((keys[order], signed[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(path_a, path_b)
        keys, signed = block.value if block else (np.zeros(0, np.int64),) * 2
        for whole in batches:
            for batch in slices(whole):
                found = Alignment(pair, batch.column("text").to_pylist())
                own, at = np.unique(found.pairs(), return_inverse=True)
                value = np.zeros(len(own), np.int64)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    value = np.where(keys[place] == own, signed[place], 0)
                value = value[at]
                out = {
                    "id": batch.column("id"), "row": batch.column("row"), "n_a": found.found.n_a, "n_b": found.found.n_b, "n_groups": found.per_doc(np.cumsum(found.cut)), "n_links": np.diff(np.concatenate(([0], found.doc_links))),
                    "n_best": found.per_doc(np.cumsum(value < 0)), "count_sum": found.per_doc(np.cumsum(np.abs(value))), "groups_sha256": found.groups(),
                }
                yield pa.RecordBatch.from_pydict({k: v if k in _OWN else pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in out.items()})

    return rows.mapInArrow(run, f"id long, row long, {', '.join(f'{n} long' for n in NUMBERS)}, groups_sha256 string")


def align(docs: DataFrame, path_a: str, path_b: str, max_pairs: int = MAX_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each document."""
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    counts = materialize(link_counts(rows, path_a, path_b), "align-counts")
    size = counts.count()
    if size <= max_pairs:
        found = measured(rows.select("id", F.lit(0).cast("long").alias("row"), "text"), path_a, path_b, counts)
    else:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "align-rows")
        blocks = -(-size * 5 // (max_pairs * 4))  # numbers of pairs in a block differ a little
        found = None
        for k in range(blocks):
            part = measured(rows, path_a, path_b, counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k))
            found = part if found is None else found.unionByName(part)
        sums = {"n_best": F.sum, "count_sum": F.sum}
        found = found.groupBy("row").agg(F.first("id").alias("id"), *[sums.get(n, F.first)(n).alias(n) for n in (*NUMBERS, "groups_sha256")])
    return found.select(F.col("id").alias("doc_id"), *NUMBERS, "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
