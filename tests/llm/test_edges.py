"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest

from gridframe.llm import decontaminate, html_text, language, licenses, line_dedup, nearest, pieces, quality, simhash, token_ids

TEXT = "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf."
LONG = " ".join(f"word{k % 977} of" for k in range(60_000)) + "."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, TEXT, "en", "a", 80), (2, None, "en", "a", None), (3, "", None, "a", 0), (4, LONG, "en", None, 1), (5, "\n\n", "en", "a", 2), (6, "12 34 !!", "de", "b", 8),
    (7, TEXT, "en", "a", 80), (None, TEXT, "en", "a", 80), (8, TEXT + "\n" + TEXT, "de", "b", 161), (9, "日本語 и русский", "xx", "b", 14), (9, "another text for one id", "en", "b", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """Extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["id", "row", "line", "fp", "component", "score", "held_out", "label", "h", "part", "seq", "chunk", "gone", "weight", "place", "sid", "variant", "kept"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


BENCH = "item_id long, text string"


def leaks(spark, docs):
    return decontaminate.find_leaks(docs, spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (None, TEXT), (4, "two words")], BENCH))


OPERATORS = {
    "op3": lambda s, d: token_ids.read_documents(token_ids.write_shards(d, token_ids.word_bpe_path())),
    "op4": leaks,
    "op5": lambda s, d: line_dedup.dedup_lines(d),
    "op6": lambda s, d: language.predict(d, language.fit(d)),
    "op7": lambda s, d: licenses.scan(d),
    "op8": lambda s, d: simhash.near_duplicates(d),
    "op9": lambda s, d: pieces.digest(d, pieces.piece_path(), chunk_chars=1000),
}
EXPECTED = {"op3": 10, "op5": 11, "op6": 11, "op7": 0, "op8": 10, "op9": 11}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(name, spark, docs, clashing):
    got = OPERATORS[name](spark, docs).collect()
    if name in EXPECTED:
        assert len(got) == EXPECTED[name]
    assert len(OPERATORS[name](spark, clashing).collect()) == len(got)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, spark, empty):
    assert OPERATORS[name](spark, empty).collect() == []


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (6, 0, 0), (5, 0, 1), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).collect() == []


def test_language_edges(spark, docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(docs, language.fit(docs)).collect()}
    assert {(2, "und"), (3, "und"), (5, "und"), (6, "und")} <= got


def test_line_dedup_edges(spark, docs):
    got = {(r["doc_id"], r["text"]): r["__n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got[2, None] == 0 and got[3, ""] == 0 and got[5, "\n\n"] == 0
    assert got[1, TEXT] == 0 and got[7, ""] == 1 and got[8, ""] == 2 and got[None, TEXT] == 0


def test_pages_edges(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, None, None), (2, "http://a.example/x", ""), (3, "not a url", "<p>Text &amp; more"), (3, "http://a.example", "<"), (None, "http://a.example", "<article><p>a<p>b</article>")]
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_text.main_text(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, None): ("", 0), (2, "http://a.example/x"): ("", 0), (3, "not a url"): ("Text & more", 11), (3, "http://a.example"): ("<", 1), (None, "http://a.example"): ("a\n\nb", 4)}
    assert html_text.main_text(spark.createDataFrame([], schema)).collect() == []


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (50, [-1.0, 0.0]), (100, [1e300, 1.0, 1.0]), (None, [1.0, 1.0])]
    vectors = nearest.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in nearest.top_k(vectors, vectors.where("id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 1, 81920), (0, 2, 2, 81920), (0, 3, 50, -65536)]
    assert [g for g in got if g[0] == 50] == [(50, 1, 0, -65536), (50, 2, 1, -65536), (50, 3, 2, -65536)]
    assert [g[3] for g in got if g[0] == 100] == [2**63 - 1]
    none = nearest.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert nearest.top_k(none, none, 5).collect() == []
