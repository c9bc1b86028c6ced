"""Cross-tokenizer alignment against a plain walk over both libraries' tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridframe.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return align.TokenPair(A, B)


def whole(pair, text):
    """((a id, start, end) ..., (b ...)) by the libraries on whole texts; none where bytes differ."""
    if not text:
        return [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    out = []
    for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return [], []
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        out.append(list(zip(ids, [0, *ends], ends)))
    return tuple(out)


def brute(pair, texts):
    walked, counts = [], Counter()
    for text in texts:
        a, b = whole(pair, text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = ["|".join(",".join(str(t[0]) for t in side if s < t[2] <= e) for side in (a, b)) for s, e in zip([0, *cuts], cuts)]
        walked.append((a, b, links, groups))
    most = Counter()
    for (_, b), c in counts.items():
        most[b] = max(most[b], c)
    return [
        (len(a), len(b), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for a, b, links, groups in walked
    ]


TEXTS = [
    None, "", " ", "a", "hello world", "Hello, World! It's 3.14.", "two  blanks   and more", " leading", "trailing ", "line\nbreak\n\nand more\n", "\nfirst", "tab\tand nbsp", "▁ its own sign", "naïve Ünï çödé 東京 😀👍🏽", "<|endoftext|> <s> </s>", "<0x0A>",
    "́combining é", "ﬁ ligature ½", "x y​z", "control \x00\x01 \x1c sign", "word " * 40, "repeated repeated", "repeated repeated",
]


def test_against_brute_force(spark, pair):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (4, "hello world")]
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    want = brute(pair, [t for _, t in rows])
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((k, *w)) for (k, _), w in zip(rows, want))


def test_several_blocks_of_pairs_give_the_same(spark, pair):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    one, many = (sorted(map(tuple, align.align(docs, A, B, max_pairs=n).collect()), key=repr) for n in (align.MAX_PAIRS, 40))
    assert one == many


def test_documents_of_the_tables(spark, sf_dir, pair):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    cut = [(r["doc_id"], (r["text"] or "")[:1500]) for r in docs]
    got = {r["doc_id"]: tuple(r)[1:] for r in align.align(spark.createDataFrame(cut, "doc_id long, text string"), A, B).collect()}
    assert got == dict(zip([k for k, _ in cut], brute(pair, [t for _, t in cut])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ,.'\n\tsté▁<|>s1"), max_size=20), max_size=5))
def test_words_apart_are_words_together(pair, texts):
    found = pair.encode(texts)
    want = [whole(pair, t) for t in texts]
    assert found.a.tolist() == [x[0] for a, _ in want for x in a] and found.n_a.tolist() == [len(a) for a, _ in want]
    assert found.b.tolist() == [x[0] for _, b in want for x in b] and found.n_b.tolist() == [len(b) for _, b in want]


def test_a_worker_that_forgets_its_words(pair, monkeypatch):
    monkeypatch.setattr(align, "MAX_WORDS", 2)
    one = pair.encode(["some words here"]).a.tolist()
    pair.encode(["other words there too"])
    assert pair.encode(["some words here"]).a.tolist() == one


def test_without_words_texts_go_whole(pair, monkeypatch):
    monkeypatch.setattr(pair, "words", False)
    assert pair.encode(["a plain text"]).a.tolist() == pair.a.encode(" a plain text", add_special_tokens=False).ids


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(empty, A, B).collect() == []
    wide = spark.createDataFrame([(1, "some text", 5, 6, "x")], "doc_id long, text string, pair long, id long, row string")
    assert align.align(wide, A, B).first()["n_links"] == 2
    long = spark.createDataFrame([(1, "very long " * 100_000)], "doc_id long, text string")
    row = align.align(long, A, B).first()
    assert row["n_groups"] >= 200_000 and row["n_links"] >= max(row["n_a"], row["n_b"])
