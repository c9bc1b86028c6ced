"""SentencePiece encoding and decoding as a max-plus parallel scan.

The ids of a text are those of the SentencePiece library for the same model file. In a
unigram model they are the segmentation with the greatest sum of piece scores. In a
merge-order (BPE) model they are the only segmentation in which every pair of
neighbouring pieces is what merging the pair's joined text gives: an allowed pair
scores 0, any other minus infinity, and a path that is allowed throughout is the best.
A character that no piece covers becomes its byte pieces.

Best sums form the max-plus semiring. A chunk of a giant text is a transfer matrix
``T[i][j]``: the best sum over the chunk if piece ``i`` crosses its start and piece ``j``
its end (of a unigram model only their ends count). Products of such matrices are
associative, so boundary states of all chunks follow from a scan over small matrices,
and then every chunk is traced back by itself. Inside a chunk, stretches that no piece
crosses (words, line ends) are 1 x 1 factors, which a worker remembers by the stretch.

Defined results: null and empty texts have no ids and decode to the empty text;
"\\u2581" in a text decodes to a blank, as that sign stands for one in the model
(``round_trip`` is false there); repeated rows and ids give repeated results; rows
with a null id keep it; long texts are cut in chunks and read whole; extra columns of any
name are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, read_table, slices, spread, text_rows

BLANK = "▁"
NONE = float("-inf")
#: Characters of a chunk.
CHUNK_CHARS = 32_768
#: Stretches a worker remembers at most.
MAX_STRETCHES = 300_000
#: And those it keeps when there are more and when a task ends, first learned and so most common.
KEPT_STRETCHES = 120_000
#: Pairs of pieces a worker remembers.
MAX_PAIRS = 100_000
#: Signs of a text that tell how long a piece may be there, and how many of such places a worker remembers.
FIRST_SIGNS = 4
MAX_PLACES = 50_000

#: Letters that may stand before a sign in a piece, so that text is still cut between other letters and that sign.
FEW_LETTERS = 3

_MODELS: dict[str, "PieceModel"] = {}


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefixes(mats: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, combined in pairs of growing distance."""
    out, step = list(mats), 1
    while step < len(out):
        out = [combine(out[k - step], m) if k >= step else m for k, m in enumerate(out)]
        step *= 2
    return out


def boundaries(mats: list[np.ndarray]) -> tuple[list[int], float]:
    """State at every chunk's start and at the end, and the best sum."""
    ahead = prefixes([mats[0][:1], *mats[1:]])
    states = [int(np.argmax(ahead[-1][0]))]
    for k in range(len(mats) - 1, 0, -1):
        states.append(int(np.argmax(ahead[k - 1][0] + mats[k][:, states[-1]])))
    return [0, *states[::-1]], float(ahead[-1][0].max())


def dumped(matrix: np.ndarray) -> bytes:
    """A matrix in few bytes, as most of its entries are alike."""
    return struct.pack("<I", matrix.shape[1]) + zlib.compress(matrix.tobytes(), 1)


def loaded(data: bytes) -> np.ndarray:
    (width,) = struct.unpack_from("<I", data)
    return np.frombuffer(zlib.decompress(data[4:])).reshape(-1, width)


#: A place in a chunk's text where a piece starts and one where it ends; neither counts from the chunk's start.
State = tuple[int, int]


class PieceModel:
    """Pieces of a model file and what a worker remembers; the subclasses hold the search."""

    def __init__(self, model):
        kinds = type(model).SentencePiece.Type
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else p.piece.encode() for p in model.pieces]
        self.unknown_id = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.unknown = min(s for _, s in self.pieces.values()) - 10
        self.longest = max(map(len, self.pieces))
        self.kind = "<u2" if len(self.raw) <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.dummy = model.normalizer_spec.add_dummy_prefix
        #: Whether no piece has a blank after another sign, and none holds a line end
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.pieces)
        self.stop = self.stops() if self.cuts else None
        self.coded = {p: np.asarray([i], self.kind).tobytes() for p, (i, _) in self.pieces.items()}
        #: Score of each id; an unknown character's is on its first byte
        self.scores = np.zeros(len(self.raw))
        self.scores[[i for i, _ in self.pieces.values()]] = [score for _, score in self.pieces.values()]
        self.scores[[i for b, i in self.byte_ids.items() if b & 0xC0 != 0x80] + [self.unknown_id]] = self.unknown
        self.found: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        return (BLANK if self.dummy and text else "") + text.replace(" ", BLANK)

    def stops(self) -> re.Pattern | None:
        """A sign after a letter, where no piece holds the two together."""
        joined: dict[str, set[str]] = {sign: set() for sign in string.punctuation}
        for piece in self.pieces:
            for a, b in zip(piece, piece[1:]):
                if b in joined and re.match(r"[^\W\d_]", a):
                    joined[b].add(a)
        signs = [sign for sign, letters in joined.items() if len(letters) <= FEW_LETTERS]
        if not signs:
            return None
        some, held = re.escape("".join(signs)), re.escape("".join(sorted(set().union(*map(joined.get, signs)))))
        return re.compile(rf"[{some}](?<=[^\W\d_{held}][{some}])")

    def stretches(self, normal: str) -> list[str]:
        """The text cut wherever no piece can cross."""
        if not self.cuts:
            return [normal] if normal else []
        if BLANK + BLANK in normal:
            return re.findall(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n", normal)
        if self.stop:
            normal = self.stop.sub(r" \g<0>", normal)
        return [x for x in normal.replace(BLANK, " " + BLANK).replace("\n", " \n ").split(" ") if x]

    def code(self, piece: str) -> bytes:
        """Ids of a piece, or of a character that none covers."""
        if piece not in self.coded:
            data = piece.encode("utf-8", "surrogatepass")
            ids = [self.byte_ids[b] for b in data] if len(self.byte_ids) == 256 else [self.unknown_id]
            return np.asarray(ids, self.kind).tobytes()
        return self.coded[piece]

    def solve(self, s: str) -> bytes:
        """Ids of a stretch."""
        raise NotImplementedError

    def remember(self, stretches: list[str]) -> None:
        if len(self.found) > MAX_STRETCHES:
            self.rest()
        for s in set(stretches).difference(self.found):
            self.found[s] = self.solve(s)

    def rest(self) -> None:
        """Forget all but the stretches learned first."""
        self.found = dict(islice(self.found.items(), KEPT_STRETCHES))

    def encode(self, normal: str) -> bytes:
        """Ids of a text of one chunk."""
        parts = self.stretches(normal)
        self.remember(parts)
        return b"".join(map(self.found.__getitem__, parts))

    def score(self, ids: bytes) -> float:
        """Sum of the file's scores of a segmentation."""
        return float(self.scores[np.frombuffer(ids, self.kind)].sum())

    # A chunk is (behind, body, ahead): pieces that start in body may end in ahead, and those
    # that start in behind may end in body. Places count from body's start.

    def cut(self, normal: str, size: int) -> Iterator[tuple[str, str, str]]:
        """The chunks of a text."""
        for at in range(0, len(normal), size):
            yield normal[max(0, at - self.longest) : at], normal[at : at + size], normal[at + size : at + size + self.longest]

    def states(self, behind: str, ahead: str) -> list[State]:
        """What can be at a boundary, in order, seen from either side."""
        raise NotImplementedError

    def edges(self, body: str) -> tuple[int, int]:
        """First and last place that no piece crosses, before a sign of the chunk; or (-1, -1)."""
        if not self.cuts:
            return -1, -1
        places = [m.start() for m in re.finditer(f"(?<=[^{BLANK}]){BLANK}|\n", body)]
        return (places[0], places[-1]) if places else (-1, -1)

    def ends(self, behind: str, body: str, ahead: str) -> tuple[list[State], list[State]]:
        """States at the chunk's start and end."""
        return self.states(behind, (body + ahead)[: self.longest]), self.states((behind + body)[-self.longest :], ahead)

    def transfer(self, behind: str, body: str, ahead: str) -> np.ndarray:
        """Best sums from each state at the chunk's start to each at its end."""
        starts, ends = self.ends(behind, body, ahead)
        first, last = self.edges(body)
        if first < 0:
            return self.sums(behind, body, ahead, starts, ends)
        head = self.sums(behind, body[:first], "", starts, self.states((behind + body[:first])[-self.longest :], "")).max(axis=1)
        tail = self.sums("", body[last:], ahead, [(0, 0)], ends)[0]
        return head[:, None] + self.worth(body[first:last]) + tail[None, :]

    def backtrace(self, behind: str, body: str, ahead: str, start: int, end: int) -> bytes:
        """Ids of the pieces that start in the chunk, given the numbers of its boundary states."""
        starts, ends = self.ends(behind, body, ahead)
        first, last = self.edges(body)
        if first < 0:
            return self.path(behind, body, ahead, starts[start], ends[end])
        at_first = self.states((behind + body[:first])[-self.longest :], "")
        best = int(self.sums(behind, body[:first], "", [starts[start]], at_first)[0].argmax())
        head = self.path(behind, body[:first], "", starts[start], at_first[best])
        return head + self.encode(body[first:last]) + self.path("", body[last:], ahead, (0, 0), ends[end])

    def worth(self, normal: str) -> float:
        """Best sum of a text between two places that no piece crosses."""
        raise NotImplementedError

    def sums(self, behind: str, body: str, ahead: str, starts: list[State], ends: list[State]) -> np.ndarray:
        """Best sums between states at the two ends of a text."""
        raise NotImplementedError

    def path(self, behind: str, body: str, ahead: str, start: State, end: State) -> bytes:
        """Ids of the best path between two states."""
        raise NotImplementedError

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, self.kind).tolist()]).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


class SumModel(PieceModel):
    """A unigram model: the greatest sum of scores. A state is the end of the piece across a boundary."""

    def __init__(self, model):
        super().__init__(model)
        #: Score of each piece, and no score for what only begins one
        self.starts = {p[:k]: NONE for p in self.pieces for k in range(1, len(p) + 1)}
        self.starts.update((p, float(score)) for p, (_, score) in self.pieces.items())

    def forward(self, s: str, start: int, end: int) -> tuple[list[float], list[int]]:
        """Best sums from ``start`` to each place, pieces starting before ``end``; and where the last piece starts."""
        best, back = [NONE] * (len(s) + 1), [0] * (len(s) + 1)
        best[start] = 0.0
        score_of, size = self.starts.get, len(s)
        for i in range(start, end):
            here = best[i]
            if here == NONE:
                continue
            covered, k = False, i + 1
            while k <= size and (score := score_of(s[i:k])) is not None:
                if score != NONE:
                    covered |= k == i + 1
                    if here + score > best[k]:
                        best[k], back[k] = here + score, i
                k += 1
            if not covered and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
        return best, back

    def trace(self, s: str, start: int, end: int, back: list[int]) -> bytes:
        out = []
        while end > start:
            out.append(self.code(s[back[end] : end]))
            end = back[end]
        return b"".join(reversed(out))

    def solve(self, s: str) -> bytes:
        return self.trace(s, 0, len(s), self.forward(s, 0, len(s))[1])

    def worth(self, normal: str) -> float:
        return self.score(self.encode(normal))

    def states(self, behind: str, ahead: str) -> list[State]:
        return [(0, e) for e in range(min(self.longest, len(ahead) + 1) if behind else 1)]

    def sums(self, behind: str, body: str, ahead: str, starts: list[State], ends: list[State]) -> np.ndarray:
        size = len(body)
        out = np.full((len(starts), len(ends)), NONE)
        for i, (_, e) in enumerate(starts):
            if e >= size:  # a piece of the chunk before ends beyond this one
                if (0, e - size) in ends:
                    out[i, ends.index((0, e - size))] = 0.0
                continue
            best, _ = self.forward(body + ahead, e, size)
            for j, (_, f) in enumerate(ends):
                out[i, j] = best[size + f]
        return out

    def path(self, behind: str, body: str, ahead: str, start: State, end: State) -> bytes:
        if start[1] >= len(body):
            return b""
        return self.trace(body + ahead, start[1], len(body) + end[1], self.forward(body + ahead, start[1], len(body))[1])


class MergeModel(PieceModel):
    """A merge-order model: every pair of neighbours is allowed. A state is the piece across a boundary."""

    def __init__(self, model):
        super().__init__(model)
        self.score_of = {p: score for p, (_, score) in self.pieces.items()}
        self.begins = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: The two pieces that are merged last in a piece; pieces that merging does not end in are not usable
        self.splits: dict[str, tuple[str, str]] = {}
        for piece in self.pieces:
            parts, pair = self.merged(piece)
            if len(parts) == 1 and pair:
                self.splits[piece] = pair
        #: Lengths of the longer ones of these pieces by their first signs, and what can start at a place by the signs there
        self.longer: dict[str, set[int]] = {}
        for piece in self.splits:
            if len(piece) > FIRST_SIGNS:
                self.longer.setdefault(piece[:FIRST_SIGNS], set()).add(len(piece))
        self.known: dict[str, list[tuple[int, str]]] = {}

    def merged(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of a short text by the rule itself (best pair first, left of equal ones), and the last pair merged."""
        parts, pair, score_of = list(s), None, self.score_of.get
        while len(parts) > 1:
            scores = [score_of(a + b, NONE) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == NONE:
                break
            at = scores.index(best)
            pair = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, pair

    def usable(self, piece: str) -> bool:
        return len(piece) == 1 or piece in self.splits

    def allowed(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` gives just ``a`` and ``b``.

        Merges are undone, the later of the two last ones first. If the pieces that then
        meet at the border would have been merged before that one, they are not apart.
        """
        score_of, splits = self.score_of, self.splits
        if a + b in score_of:
            return False
        of_a = score_of[a] if len(a) > 1 else -NONE
        of_b = score_of[b] if len(b) > 1 else -NONE
        while True:
            if of_a < of_b:
                a = splits[a][1]
                if score_of.get(a + b, NONE) > of_a:
                    return False
                of_a = score_of[a] if len(a) > 1 else -NONE
            elif len(b) > 1:  # of equal scores the left one is merged first
                b = splits[b][0]
                if score_of.get(a + b, NONE) >= of_b:
                    return False
                of_b = score_of[b] if len(b) > 1 else -NONE
            else:
                return True

    def pair_allowed(self, pair: tuple[str, str]) -> bool:
        """``allowed``, remembered."""
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[pair] = self.allowed(*pair)
        return found

    def choices(self, signs: str) -> list[tuple[int, str]]:
        """Lengths of what may start at a place, longest first, and the piece if the first signs there hold it."""
        if len(self.known) > MAX_PLACES:
            self.known.clear()
        short = [(k, signs[:k]) for k in range(len(signs), 0, -1) if k == 1 or signs[:k] in self.splits]
        self.known[signs] = [(k, "") for k in sorted(self.longer.get(signs, ()), reverse=True)] + short
        return self.known[signs]

    def solve(self, s: str) -> bytes:
        """The allowed path, looked for with long pieces first; a place that led nowhere is not tried again."""
        size, pieces, dead, last = len(s), [], set(), ""
        splits, known, pairs, allowed, coded = self.splits, self.known.get, self.pairs.get, self.pair_allowed, self.coded.get
        at, upto = 0, size
        while at < size:
            signs = s[at : at + FIRST_SIGNS]
            for length, piece in known(signs) or self.choices(signs):
                k = at + length
                if k > upto or k in dead:
                    continue
                if not piece:
                    piece = s[at:k]
                    if piece not in splits:
                        continue
                if last:
                    pair = last, piece
                    fits = pairs(pair)
                    if not (allowed(pair) if fits is None else fits):
                        continue
                pieces.append(piece)
                last, at, upto = piece, k, size
                break
            else:
                dead.add(at)
                upto = at - 1
                at -= len(pieces.pop())
                last = pieces[-1] if pieces else ""
        return b"".join([coded(p) or self.code(p) for p in pieces])

    def ahead_of(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that start at a place."""
        out, k = [at + 1], at + 2
        while k <= len(text) and text[at:k] in self.begins:
            if self.usable(text[at:k]):
                out.append(k)
            k += 1
        return out

    def worth(self, normal: str) -> float:
        return 0.0  # every stretch has its allowed path

    def states(self, behind: str, ahead: str) -> list[State]:
        if not behind:
            return [(0, 0)]
        text, border = behind + ahead, len(behind)
        return [(p - border, k - border) for p in range(max(0, border - self.longest), border) for k in self.ahead_of(text, p) if k >= border]

    def walk(self, text: str, starts: list[State], border: int, size: int) -> dict[int, dict[int, list[int]]]:
        """end -> start -> [numbers of the start states as bits, start before] of the last pieces of allowed paths."""
        seen: dict[int, dict[int, list[int]]] = {}
        known: dict[tuple[str, str], bool] = {}  # pairs that were looked at
        for i, (s, e) in enumerate(starts):
            seen.setdefault(border + e, {}).setdefault(border + s, [0, -1])[0] |= 1 << i
        for at in range(border, border + size):
            if at not in seen:
                continue
            ends = self.ahead_of(text, at)
            for before, (bits, _) in seen[at].items():
                last = text[before:at]
                for k in ends:
                    pair = last, text[at:k]
                    if last and pair not in known:
                        known[pair] = self.allowed(*pair)
                    if not last or known[pair]:
                        entry = seen.setdefault(k, {}).setdefault(at, [0, before])
                        entry[0] |= bits
        return seen

    def sums(self, behind: str, body: str, ahead: str, starts: list[State], ends: list[State]) -> np.ndarray:
        border, size = len(behind), len(body)
        seen = self.walk(behind + body + ahead, starts, border, size)
        out = np.full((len(starts), len(ends)), NONE)
        for j, (s, e) in enumerate(ends):
            bits = seen.get(border + size + e, {}).get(border + size + s, [0])[0]
            out[[i for i in range(len(starts)) if bits >> i & 1], j] = 0.0
        return out

    def path(self, behind: str, body: str, ahead: str, start: State, end: State) -> bytes:
        text, border = behind + body + ahead, len(behind)
        seen = self.walk(text, [start], border, len(body))
        out, k, at = [], border + len(body) + end[1], border + len(body) + end[0]
        while at >= border and k > border + start[1]:
            out.append(self.code(text[at:k]))
            k, at = at, seen[k][at][1]
        return b"".join(reversed(out))


def open_model(path: str, model_type: int | None = None) -> PieceModel:
    """The model of a file, by its own type or another (1: unigram, 2: merge order)."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    read = proto.ModelProto()
    with open(path, "rb") as file:
        read.ParseFromString(file.read())
    kind = model_type or read.trainer_spec.model_type
    if kind not in (1, 2):
        raise ValueError(f"{path}: neither a unigram nor a merge-order model")
    return (SumModel if kind == 1 else MergeModel)(read)


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = open_model(path)
    return _MODELS[path]


class Opened:
    """A model by its path, to be broadcast: a worker opens it once and drops it, and what it remembers, when it gets other work."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def model(self) -> PieceModel:
        return open_model(self.path)


CODED = "doc_id long, n_tokens long, ids binary, score double, n_chunks int, text string"


def full_rows(m: PieceModel, doc_ids: pa.Array, ids: list[bytes], scores: list[float], n_chunks: list[int], texts: list[str]) -> pa.RecordBatch:
    """Rows of ``encode``."""
    return pa.RecordBatch.from_pydict({"doc_id": doc_ids, "n_tokens": [len(i) // m.width for i in ids], "ids": pa.array(ids, pa.binary()), "score": scores, "n_chunks": pa.array(n_chunks, pa.int32()), "text": pa.array(texts, pa.string())})


def digest_rows(m: PieceModel, doc_ids: pa.Array, ids: list[bytes], scores: list[float], n_chunks: list[int], texts: list[str]) -> pa.RecordBatch:
    """Rows of ``digest``."""
    same = [m.decode(x) == t for x, t in zip(ids, texts)]
    sums = [zlib.crc32(np.frombuffer(x, m.kind).astype("<u4").tobytes()) for x in ids]
    return pa.RecordBatch.from_pydict({"doc_id": doc_ids, "n_tokens": [len(i) // m.width for i in ids], "ids_crc32": pa.array(sums, pa.int64()), "score": scores, "n_chunks": pa.array(n_chunks, pa.int32()), "round_trip": pa.array(same, pa.bool_())})


def encode(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, id_col: str = "doc_id", text_col: str = "text", rows_of: Callable[..., pa.RecordBatch] = full_rows, schema: str = CODED) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (little-endian), score, n_chunks, text.

    ``rows_of`` and ``schema`` turn the coded texts into other rows where they are made.

    Texts of one chunk are coded where they are read. Chunks of giant texts are
    dealt out one by one; only their matrices, far smaller than the text, meet by
    document.
    """
    rows = spread(text_rows(docs, id_col, text_col))
    sent = docs.sparkSession.sparkContext.broadcast(Opened(path))
    size = F.length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.model
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                coded = [m.encode(m.normal(t)) for t in texts]
                yield rows_of(m, batch.column("id"), coded, [m.score(c) for c in coded], [1] * len(coded), texts)
        m.rest()

    small = rows.where(size < chunk_chars).mapInArrow(short, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.model
        for batch in batches:
            for doc_id, row, text in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                parts, at = m.cut(m.normal(text), chunk_chars), 0
                while part := list(islice(parts, 64)):
                    behind, body, ahead = zip(*part)
                    yield pa.RecordBatch.from_pydict({"row": [row] * len(part), "id": pa.array([doc_id] * len(part), pa.int64()), "chunk": pa.array(range(at, at + len(part)), pa.int32()), "behind": behind, "body": body, "ahead": ahead})
                    at += len(part)

    def transfers(batch: pa.RecordBatch) -> dict:
        m = sent.value.model
        mats = [dumped(m.transfer(*x)) for x in zip(*[batch.column(c).to_pylist() for c in ("behind", "body", "ahead")])]
        return {k: batch.column(k) for k in ("row", "id", "chunk", "behind", "body", "ahead")} | {"matrix": mats}

    chunk_cols = "row string, id long, chunk int, behind string, body string, ahead string"
    giant = rows.where(size >= chunk_chars).withColumn("row", F.uuid())
    chunks = giant.mapInArrow(cut, chunk_cols).repartition("row", "chunk")
    chunks = materialize(map_batches(chunks, transfers, chunk_cols + ", matrix binary"), "piece-chunks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, mats in zip(batch.column("row").to_pylist(), batch.column("mats").to_pylist()):
                states, _ = boundaries([loaded(x["matrix"]) for x in mats])
                n = len(mats)
                yield pa.RecordBatch.from_pydict({"s_row": [row] * n, "s_chunk": pa.array(range(n), pa.int32()), "first": pa.array(states[:-1], pa.int32()), "last": pa.array(states[1:], pa.int32())})

    by_doc = chunks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("mats"))
    states = by_doc.mapInArrow(scan, "s_row string, s_chunk int, first int, last int")

    def traced(batch: pa.RecordBatch) -> dict:
        m = sent.value.model
        cols = [batch.column(c).to_pylist() for c in ("behind", "body", "ahead", "first", "last")]
        return {"row": batch.column("row"), "id": batch.column("id"), "chunk": batch.column("chunk"), "body": batch.column("body"), "ids": [m.backtrace(*x) for x in zip(*cols)]}

    joined = chunks.drop("matrix").join(states, (F.col("row") == F.col("s_row")) & (F.col("chunk") == F.col("s_chunk")))
    parts = map_batches(joined, traced, "row string, id long, chunk int, body string, ids binary")
    whole = parts.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("chunk", "ids", "body"))).alias("parts"))

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.model
        for whole in batches:
            for batch in slices(whole):
                parts = batch.column("parts").to_pylist()
                ids = [b"".join([p["ids"] for p in x]) for x in parts]
                texts = ["".join([p["body"] for p in x])[1 if m.dummy else 0 :].replace(BLANK, " ") for x in parts]
                yield rows_of(m, batch.column("id"), ids, [m.score(x) for x in ids], [len(x) for x in parts], texts)
        m.rest()

    return small.unionByName(whole.mapInArrow(glue, schema))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, and drops nothing."""
    schema = coded.schema
    sent = coded.sparkSession.sparkContext.broadcast(Opened(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.model
        for whole in batches:
            for batch in slices(whole):
                texts = [m.decode(x or b"") for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, type(schema)([*schema.fields]).add("decoded", "string"))


def digest(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (as unsigned 32-bit ids), score, n_chunks, round_trip."""
    schema = "doc_id long, n_tokens long, ids_crc32 long, score double, n_chunks int, round_trip boolean"
    return encode(docs, path, chunk_chars, rows_of=digest_rows, schema=schema)


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"), piece_path())
