"""Token-id output with Elias-Fano document boundaries.

A shard is one self-contained byte string::

    magic "GFEF" | u8 version | u8 id width | u16 0 | u64 documents | u64 ids
    | u64 low bits | doc ids (i64 each) | low parts | high parts | ids

The boundary sequence (the end of each document, in ids) is monotone, so it is
kept in Elias-Fano form: ``low bits`` bits of each value verbatim and the rest as
a unary-gap bitmap, about ``2 + log2(ids / documents)`` bits a document. ``select``
over the bitmap gives any offset back without a table of 64-bit offsets.

Shards are rows of a table in the shared folder, because Spark commits tables
atomically on every store and replays a lost task; ``shard_bytes`` of a row can be
dumped to a file unchanged. Shards are in ascending document order.

A tokenizer whose normaliser and pre-tokenizer are known to work word by word is asked once
a word; any other gets whole texts.

Defined results: a null or empty text is a document that holds the end id alone;
rows with a null id are not documents and are left out; equal ids, also of repeated rows,
keep one boundary each, in any order; very long texts stay whole in one shard; extra columns
of any name are left aside; an empty table gives no shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, text_rows

MAGIC = b"GFEF"
HEAD = struct.Struct("<4sBBHQQQ")
#: Ids after which a shard is closed; a longer document still stays whole.
SHARD_IDS = 4_000_000
#: Words a worker remembers before it starts anew.
MAX_WORDS = 800_000
#: Shards whose bases (three numbers each) are broadcast; beyond, they meet by a shuffle.
MAX_BROADCAST = 100_000


# ---------------------------------------------------------------- Elias-Fano


def ef_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(low bits, low parts, high bitmap) of an ascending sequence."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if n == 0:
        return 0, b"", b""
    low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
    if low_bits:
        shifts = np.arange(low_bits, dtype=np.uint64)
        bits = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
    else:
        low = b""
    high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bitmap = np.zeros(int(high[-1]) + 1, dtype=np.uint8)
    bitmap[high] = 1
    return low_bits, low, np.packbits(bitmap, bitorder="little").tobytes()


class EliasFano:
    """``select`` over an encoded ascending sequence."""

    BLOCK = 64  # bytes of bitmap between two counts

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), self.BLOCK))))) if n else np.zeros(1, np.int64)

    def select(self, i: int) -> int:
        """The i-th value, from the counts and one block of bitmap."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        at = block * self.BLOCK
        ones = np.flatnonzero(np.unpackbits(self.high[at : at + self.BLOCK], bitorder="little"))
        high = at * 8 + int(ones[i - int(self.before[block])]) - i
        low = 0
        for bit in range(self.low_bits):
            j = i * self.low_bits + bit
            low |= (int(self.low[j >> 3]) >> (j & 7) & 1) << bit
        return (high << self.low_bits) | low

    def all(self) -> np.ndarray:
        """Every value at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


# ---------------------------------------------------------------- shard format


def pack_shard(doc_ids: list[int], counts: list[int], ids: bytes, width: int) -> bytes:
    ends = np.cumsum(np.asarray(counts, dtype=np.int64))
    low_bits, low, high = ef_encode(ends)
    head = HEAD.pack(MAGIC, 1, width, 0, len(doc_ids), len(ids) // width, low_bits)
    return b"".join((head, struct.pack("<QQ", len(low), len(high)), np.asarray(doc_ids, "<i8").tobytes(), low, high, ids))


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, data: bytes):
        magic, version, width, _, n, total, low_bits = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        n_low, n_high = struct.unpack_from("<QQ", data, HEAD.size)
        at = HEAD.size + 16
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        at += 8 * n
        self.ends = EliasFano(n, low_bits, data[at : at + n_low], data[at + n_low : at + n_low + n_high])
        at += n_low + n_high
        self.ids = np.frombuffer(data, {2: "<u2", 4: "<u4"}[width], total, at)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def offsets(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.offsets(i)
        return self.ids[start:end]


# ---------------------------------------------------------------- encoding

_ENCODERS: dict[str, "TextEncoder"] = {}
#: A word of letters that have no combining forms, then ASCII signs: both are tokens of their own.
SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-/:-@\[-^`{-~]*)")
#: Texts that are not lowered and cut beforehand: letters with combining forms or odd case, special tokens.
ODD = re.compile(r"[^\x00-\u012F\u0131-\u024F]")
STOP = re.compile(r"(?<=[a-z\u00E0-\u00F6\u00F8-\u00FF])([.,])(?=[ \n]|\Z)")


#: Normaliser and pre-tokenizer under which a text's ids are those of its words (fixed values).
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def by_words(spec: dict) -> bool:
    """Whether a tokenizer's description allows ``WordEncoder``."""
    before = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") == WORD_NORMALIZER and before.get("type") == "Sequence" and before.get("pretokenizers") == [WORD_SPLIT, WORD_BYTES] and bool(spec["model"].get("end_of_word_suffix")) and not spec["model"].get("dropout")
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in spec.get("added_tokens", ()))
    )


class TextEncoder:
    """Ids of whole texts through the tokenizers library, for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(found.ids, self.kind).tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordEncoder(TextEncoder):
    """Ids of whole texts through the tokenizers library, one call a new word.

    The pre-tokenizer drops white space and neither it nor the normalizer looks
    across it, so a text's ids are those of its parts between ASCII blanks. It also
    cuts between letters and signs and lowers letters, so "Word," needs the library
    only for "word" and ",".
    """

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        self.known: dict[str, bytes] = {"": b""}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for piece, i in vocab.items() if suffix and piece.endswith(suffix)]] = True

    def learn(self, words: list[str]) -> None:
        """Words that are one token each before merging: encoded as one text, cut where a word ends."""
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.closes[ids]) + 1) * self.width
            if len(ends) == len(some) and (not len(ids) or ends[-1] == len(ids) * self.width):
                data, start = ids.tobytes(), 0
                for word, end in zip(some, ends.tolist()):
                    self.known[word] = data[start:end]
                    start = end
            else:
                self.learn_each(some)

    def learn_each(self, words: list[str]) -> None:
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[word] = np.asarray(found.ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        texts = [t if "<|" in t or not t.isascii() and ODD.search(t) else STOP.sub(r" \1", t.lower()) for t in texts]
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known = {"": b""}
        known = self.known
        split, plain, rest = {}, set(), []
        for word in set().union(*parts).difference(known):
            if match := SIMPLE.fullmatch(word):
                split[word] = pair = match[1].lower(), match[2]
                plain.update(x for x in pair if x not in known)
            else:
                rest.append(word)
        self.learn(list(plain))
        self.learn_each(rest)
        for word, (letters, signs) in split.items():
            known[word] = known[letters] + known[signs]
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _ENCODERS[path] = (WordEncoder if by_words(json.loads(tokenizer.to_str())) else TextEncoder)(tokenizer)
    return _ENCODERS[path]


SHARDS = "part int, seq int, n_docs long, n_ids long, shard_bytes binary"


def encode_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, partitions: int | None = None, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard rows (part, seq, n_docs, n_ids, shard_bytes) in ascending document order."""
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col).where("id is not null")
    rows = rows.repartitionByRange(partitions, "id") if partitions else rows.repartitionByRange("id")
    rows = rows.sortWithinPartitions("id").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.kind).tobytes()
        doc_ids, counts, pieces, size, seq, part = [], [], [], 0, 0, 0

        def shard():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(doc_ids)], "n_ids": [size], "shard_bytes": pa.array([pack_shard(doc_ids, counts, b"".join(pieces), enc.width)], pa.binary())})

        for whole in batches:
            for batch in slices(whole):
                part = batch.column("part")[0].as_py() if batch.num_rows else part
                for doc_id, ids in zip(batch.column("id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                    doc_ids.append(doc_id)
                    counts.append(len(ids) // enc.width + 1)
                    pieces.append(ids + end)
                    size += counts[-1]
                    if size >= shard_ids:
                        yield shard()
                        doc_ids, counts, pieces, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield shard()

    return rows.mapInArrow(run, SHARDS)


def write_shards(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``encode_shards``, written to the shared folder and opened again."""
    return materialize(encode_shards(docs, tokenizer, **options), "token-shards")


def bases(shards: DataFrame) -> DataFrame:
    """(b_part, b_seq, base): ids in all shards before. Two levels, so no window spans the table."""
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each range partition of the write, a number fixed by the session
    earlier = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offsets = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own"))
    return offsets.join(earlier, F.col("part") == F.col("p")).select(F.col("part").alias("b_part"), F.col("seq").alias("b_seq"), (F.col("own") + F.col("before")).alias("base"))


def read_documents(shards: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document, from the shards alone: doc_id, start, n_tokens, ids_crc32.

    A shard's base joins the few numbers of its documents, never its bytes: by
    broadcast up to ``max_broadcast`` shards, by a shuffle of those numbers beyond.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("shard_bytes")):
                shard = Shard(data.as_py())
                ends = shard.ends.all()
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                sums = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(ends), pa.int32()), "seq": pa.array([seq] * len(ends), pa.int32()), "doc_id": pa.array(shard.doc_ids), "own": pa.array(starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    found = shards.select("part", "seq", "shard_bytes").mapInArrow(run, "part int, seq int, doc_id long, own long, n_tokens long, ids_crc32 long")
    base = bases(shards)
    base = F.broadcast(base) if shards.count() <= max_broadcast else base.hint("merge")
    met = found.join(base, (F.col("part") == F.col("b_part")) & (F.col("seq") == F.col("b_seq")))
    return met.select("doc_id", (F.col("own") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(read_table(spark, sf_dir, "documents"), word_bpe_path()))
