"""Collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridframe.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", lowered)]


def brute(rows, min_count, max_words=3, absorb=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    gone = set()
    for (lang, p), a in cand.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * a >= absorb * f[lang, p[i : i + size]]:
                    gone.add((lang, p[i : i + size]))
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            score, k, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, left, right, n[lang], score))
    return sorted((lang, rank + 1, x[2].decode(), *x[3:]) for lang, xs in out.items() for rank, x in enumerate(sorted(xs)[:top]))


def got(spark, rows, **options):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def random_rows(seed, n=60):
    g = np.random.default_rng(seed)
    words = ["a", "B", "c", "dd", "É", "é", "e f", "x\x1cy"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?"]
    rows = []
    for _ in range(n):
        size = int(g.integers(0, 60))
        rows.append(("".join(words[int(x)] + seps[int(g.integers(len(seps)))] for x in g.integers(0, len(words), size) ** 2 // len(words)), ["en", "fr", None, "und"][int(g.integers(4))]))
    return rows + [(None, "en"), ("", None), ("a a a a a a a a a a a a", "en")]


@pytest.mark.parametrize("shard_bytes", [C.SHARD_BYTES, 40])
def test_random_texts(spark, shard_bytes):
    rows = random_rows(1)
    for options in ({"min_count": 3}, {"min_count": 10}, {"min_count": 3, "max_words": 4, "top": 7}):
        assert got(spark, rows, shard_bytes=shard_bytes, **options) == brute(rows, **{"min_count": 3} | options)


def test_the_tables(spark, sf_dir, same_as_sql):
    same_as_sql(C.query, C.ORACLE)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").collect()
    assert sorted(tuple(r) for r in C.query(spark, sf_dir).collect()) == brute([tuple(r) for r in docs], 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", ".", "a b"]), max_size=80), st.integers(1, 30))
def test_bitmaps_of_a_shard(tokens, step):
    class Everything:
        def has(self, hashed):
            return np.ones(len(hashed), bool)

    text = " ".join(tokens)
    want = Counter()
    for words in pieces(text):
        want.update(" ".join(words[i : i + 3]) for i in range(len(words) - 2))
    found = Counter()
    for phrases, sums in C.phrase_counts(C.Shard(b"en", [text.encode()]), 3, [Everything()] * 2, step):
        for p, n in zip(phrases.to_pylist(), sums.tolist()):
            found[p.decode()] += n
    assert found == want


def test_a_long_text_is_cut_between_pieces(spark):
    text = "one two three, four five. " * 3_000
    assert b",".join(C.cut_text(text.encode(), 1_000)).count(b"three") == 3_000
    assert got(spark, [(text, "en")], shard_bytes=1_000) == brute([(text, "en")], 10)
    assert list(C.cut_text(b"no end at all" * 9, 10)) == [b"no end at all" * 9]


def test_wrong_hits_of_the_bit_table_change_nothing(spark, monkeypatch):
    class Everything(C.BitTable):
        def __init__(self, *_):
            super().__init__(np.full(C.FILTER_BITS >> 6, ~np.uint64(0)))

    rows = random_rows(3)
    monkeypatch.setattr(C, "bit_table", lambda frequent: C.BitTable(np.full(C.FILTER_BITS >> 6, ~np.uint64(0))))
    assert got(spark, rows, min_count=4) == brute(rows, 4)


def test_large_numbers_are_exact(spark):
    row = spark.createDataFrame([(9_007_199_254_740_993, 9_007_199_254_740_995, 9_007_199_254_740_997)], "a long, l long, r long")
    a, left, right = row.first()
    assert row.select(C.score("a", "l", "r").alias("s")).first()["s"] == 10**6 * a * a // (left * right)


def test_edges(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None), ("", "en"), (". , ;", "en")]) == []
    wide = spark.createDataFrame([("w x " * 10, "en", 1, "p", 3)], "text string, lang string, f long, phrase string, rank long")
    assert C.collocations(wide).count() > 0
