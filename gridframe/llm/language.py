"""Language identification of whole and mixed texts by Viterbi over words.

The scripts of a word's letters narrow the candidates to languages seen in that
script; each candidate scores the word by the log share of its character n-grams.
Along the text a Viterbi path may change language at a penalty, which labels spans of
mixed text. The language with most letters on the path is predicted; its score is
that share times the mean posterior of its words.

Fitting sees at most ``MAX_DOCS`` documents of a language (those with the smallest
hashes of their id in each of 64 parts, one text of each id) and ``MAX_SAMPLE`` in all, and
of their words the ``MAX_LEARNED`` most frequent of a language, a documented bound;
prediction sees every whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0; so
is every text if nothing was learned; a text whose letters are of no learned script is
given the likeliest of all languages; rows with a null id are predicted, with
``held_out`` null; repeated rows repeat their result and are learned once; an id with several
languages is learned for each from its rows of that language; ties go to the first language
by name; very long texts are read whole; extra columns of any name are left aside (the
pipeline's stage keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, read_table, slices, spread, text_rows

MAX_DOCS = 640
#: Parts of a language's ids from which equal numbers are taken.
PARTS = 64
MAX_SAMPLE = 50_000
#: Words of a language, by frequency, that the model is made of.
MAX_LEARNED = 200_000
#: Cost in nats of changing language between two words.
SWITCH = 7.0
#: Posteriors below this do not count against a language, so one odd word decides nothing.
FLOOR = -9.0
MAX_WORDS = 250_000
ORDER = 3

#: Script ranges (fixed values): name, first and last code point.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]


def script(letter: str) -> str:
    code = ord(letter)
    return next((name for name, first, last in SCRIPTS if first <= code <= last), "other")


def scripts(word: str) -> set[str]:
    return {"latin"} if word.isascii() else {script(c) for c in word if c.isalpha()}


def letters(word: str) -> str:
    """The word's letters and marks between letters, lower case."""
    kept = word.lower()
    return kept if kept.isalpha() else "".join(c for c in kept if c.isalpha() or unicodedata.category(c) == "Mn")


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for n in range(1, ORDER + 1) for i in range(len(padded) - n + 1)]


class LanguageModel:
    """N-gram log shares by language, and the path over a batch of texts."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        total = {n: np.zeros(len(self.langs)) for n in range(1, ORDER + 1)}
        seen: dict[str, np.ndarray] = {}
        self.scripts: dict[str, np.ndarray] = {}
        for k, lang in enumerate(self.langs):
            for word, n in counts[lang].items():
                for s in scripts(word):
                    self.scripts.setdefault(s, np.zeros(len(self.langs)))[k] += n
                for g in grams(word):
                    seen.setdefault(g, np.zeros(len(self.langs)))[k] += n
                    total[len(g)][k] += n
        kinds = Counter(len(g) for g in seen)
        unseen = np.array([np.log(0.5 / (total[n] + 0.5 * max(1, kinds[n]))) for n in range(1, ORDER + 1)])
        share = np.array([np.log((c + 0.5) / (total[len(g)] + 0.5 * kinds[len(g)])) for g, c in seen.items()]).reshape(len(seen), len(self.langs))
        #: Rows of unseen n-grams by size, then those of seen ones
        self.logs = np.vstack([unseen.reshape(ORDER, len(self.langs)), share])
        self.row_of = {g: ORDER + k for k, g in enumerate(seen)}
        #: A script belongs to a language if it has a thousandth of its letters
        own = {s: c / np.maximum(1, sum(self.scripts.values())) for s, c in self.scripts.items()}
        self.allowed = {s: c >= 0.001 for s, c in own.items()}
        self.all_allowed = all(a.all() for a in self.allowed.values())
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of words."""
        self.known = {}
        self.table = np.zeros((1, len(self.langs)))
        self.size = np.zeros(1, np.int64)

    def learn(self, words: set[str]) -> None:
        """Number the words' log posteriors; 0 is for words without letters."""
        known, row_of = self.known, self.row_of
        own = {w: letters(w) for w in words}
        new = [w for w in dict.fromkeys(own.values()) if w and w not in known]
        step = 20_000
        for at in range(0, len(new), step):
            some = new[at : at + step]
            rows, starts = [], []
            for word in some:
                starts.append(len(rows))
                padded = f"^{word}$"
                for n in range(1, ORDER + 1):
                    unseen = n - 1
                    rows += [row_of.get(padded[i : i + n], unseen) for i in range(len(padded) - n + 1)]
            scores = np.add.reduceat(self.logs[rows], starts, axis=0)
            odd = {} if self.all_allowed else {k: m for k, w in enumerate(some) if (m := self.mask(w)) is not None}
            for k, m in odd.items():
                scores[k, ~m] = -np.inf
            scores -= scores.max(axis=1, keepdims=True)
            scores = np.maximum(scores - np.log(np.exp(scores).sum(axis=1, keepdims=True)), FLOOR)
            known.update(zip(some, range(len(self.table), len(self.table) + len(some))))
            self.table = np.vstack([self.table, scores])
            self.size = np.concatenate([self.size, np.array([len(w) for w in some])])
        for word, base in own.items():
            known[word] = known[base] if base else 0

    def mask(self, word: str) -> np.ndarray | None:
        """Languages of the word's scripts, if they are fewer than all."""
        masks = [self.allowed[s] for s in scripts(word) if s in self.allowed]
        allowed = np.any(masks, axis=0) if masks else None
        return allowed if allowed is not None and allowed.any() and not allowed.all() else None

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MAX_WORDS:
            self.forget()
        parts = [t.split() for t in texts]
        known = self.known
        self.learn(set().union(*parts).difference(known))
        return [np.fromiter(map(known.__getitem__, p), np.int32, len(p)) for p in parts]

    def paths(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: (labels, log posteriors, letters) of its words that have letters."""
        numbers = [n[n > 0] for n in self.numbers(texts)]
        table, size = self.table, self.size
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: -len(numbers[i]))
        at = 0
        while at < len(order):  # texts of like length side by side, longest first
            longest = len(numbers[order[at]])
            group = [i for i in order[at : at + 512] if 2 * len(numbers[i]) >= longest or not longest]
            group = group[: max(1, 4_000_000 // max(1, longest * len(self.langs)))]
            at += len(group)
            if not longest:
                for i in group:
                    out[i] = (np.zeros(0, np.int64), np.zeros((0, len(self.langs))), np.zeros(0, np.int64))
                continue
            lengths = np.array([len(numbers[i]) for i in group])
            ids = np.zeros((longest, len(group)), np.int32)
            for column, i in enumerate(group):
                ids[: lengths[column], column] = numbers[i]
            labels = self.viterbi(table, ids, lengths)
            for column, i in enumerate(group):
                out[i] = (labels[: lengths[column], column], table[numbers[i]], size[numbers[i]])
        return out

    @staticmethod
    def viterbi(table: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Labels (place, text) of best paths; word 0, past a text's end, changes nothing."""
        steps, width = ids.shape
        stays = np.ones((steps, width, table.shape[1]), dtype=bool)
        jump_from = np.zeros((steps, width), np.int16)
        best = table[ids[0]]
        for t in range(1, steps):
            top = best.argmax(axis=1)
            jump = best[np.arange(width), top][:, None] - SWITCH
            stays[t] = best >= jump
            jump_from[t] = top
            best = np.where(stays[t], best, jump) + table[ids[t]]
        labels = np.zeros((steps, width), np.int64)
        labels[-1] = best.argmax(axis=1)
        columns = np.arange(width)
        for t in range(steps - 1, 0, -1):
            labels[t - 1] = np.where(stays[t, columns, labels[t]], labels[t], jump_from[t])
        return labels

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        return [(lang, score) for lang, score, _ in self.judge(texts)]

    def judge(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, mean posterior of all words along the path) of each text."""
        if not self.langs:
            return [("und", 0.0, 0.0)] * len(texts)
        out = []
        for labels, logs, size in self.paths(texts):
            if not len(labels):
                out.append(("und", 0.0, 0.0))
                continue
            share = np.bincount(labels, weights=size, minlength=len(self.langs))
            top = int(share.argmax())
            mine = labels == top
            sure = float((np.exp(logs[mine, top]) * size[mine]).sum() / size[mine].sum())
            path = float((np.exp(logs[np.arange(len(labels)), labels]) * size).sum() / size.sum())
            out.append((self.langs[top], float(share[top] / share.sum()) * (0.5 + 0.5 * sure), path))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, end, language) of the path; words without letters join the span before."""
        words = text.split()
        numbers = self.numbers([text])[0]
        labels = iter(self.paths([text])[0][0])
        spans: list[tuple[int, int, str]] = []
        for k, number in enumerate(numbers[: len(words)]):
            lang = self.langs[next(labels)] if number else (spans[-1][2] if spans else "und")
            if spans and spans[-1][2] == lang:
                spans[-1] = (spans[-1][0], k + 1, lang)
            else:
                spans.append((k, k + 1, lang))
        return spans


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> LanguageModel:
    """Count words by language over a bounded sample of documents that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    ids = usable.select(F.col("doc_id").cast("long").alias("s_id"), F.col("lang").cast("string").alias("s_lang")).distinct().withColumn("h", F.xxhash64("s_id"))
    # a language may hold most rows: the smallest hashes of each of 64 parts of it
    own = Window.partitionBy("s_lang", F.pmod("h", F.lit(PARTS))).orderBy("h", "s_id")
    ranked = ids.withColumn("n", F.row_number().over(own)).where(F.col("n") <= max(1, max_docs // PARTS))
    sample = F.broadcast(ranked.orderBy("n", "h").limit(MAX_SAMPLE).select("s_id", "s_lang"))  # two columns of MAX_SAMPLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("s_lang").to_pylist(), batch.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(filter(None, map(letters, text.split())))
        for lang, own in counts.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "word": list(own), "n": pa.array(own.values(), pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("own_lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(sample, (F.col("id") == F.col("s_id")) & (F.col("own_lang") == F.col("s_lang"))).groupBy("s_id", "s_lang").agg(F.min("text").alias("text"))
    counted = rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counted = counted.withColumn("place", F.row_number().over(common)).where(F.col("place") <= MAX_LEARNED).drop("place")
    counts: dict[str, Counter] = {}
    got = counted.toArrow()
    for lang, word, n in zip(got.column("lang").to_pylist(), got.column("word").to_pylist(), got.column("n").to_pylist()):
        counts.setdefault(lang, Counter())[word] += n
    return LanguageModel(counts)


def predict(docs: DataFrame, fitted: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    fitted.forget()
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                got = sent.value.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())})
        sent.value.forget()  # an idle worker keeps no words

    return spread(text_rows(docs)).withColumn("held_out", held_out("id", 4, 2)).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


#: Texts without a language are rejected, and those below this in both score and mean posterior.
MIN_SCORE = 0.5


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs`` whose language, or languages, are identified, all columns as they were.

    The score holds the share of one language; a text of several is kept if the words
    are certain along the path.
    """
    fitted = fit(docs)
    fitted.forget()
    sent = docs.sparkSession.sparkContext.broadcast(fitted)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([lang != "und" and max(score, path) >= min_score for lang, score, path in sent.value.judge(texts)], pa.bool_()))
        sent.value.forget()

    return spread(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
