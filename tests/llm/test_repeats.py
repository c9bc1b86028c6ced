"""Repeated ids and rows, clashing columns, long runs, and the helpers for tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridframe.llm import common, language, line_dedup, nearest, quality, simhash, token_ids

A, B = "one text of some words that is long enough", "another text that has nothing to do with it at all"
DOCS = "doc_id long, text string"


def test_fingerprint_ids_link_nothing(spark):
    rows = [(3, A), (5, A), (5, B), (7, B), (7, B), (None, A)]
    got = sorted((r["id"], r["component"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (7, 5)]


def test_long_runs_are_cut(spark, sf_dir):
    """A run cut by salt gives the components of a whole one."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    group = spark.range(400).select((F.col("id") + 10_000).alias("doc_id"), F.concat_ws(" ", *[F.lit(f"w{k}") for k in range(60)], F.concat(F.lit("x"), F.col("id"))).alias("text"))
    rows = docs.union(group)
    want = sorted(map(tuple, simhash.near_duplicates(rows).collect()))
    assert sorted(map(tuple, simhash.near_duplicates(rows, long_run=30).collect())) == want


def test_quality_repeats(spark):
    rows = [(k % 12, (A if k % 2 else "!!! $$$ " * (k % 12 + 1)), "x", "y", "z") for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS + ", held_out string, score string, label_id string")
    labels = spark.createDataFrame([(k % 12, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    ranker = quality.fit(docs, labels)
    got = quality.score(docs, ranker).collect()
    assert len(got) == 60 and all(r["predicted"] == r["doc_id"] % 2 for r in got)
    once = quality.fit(docs.dropDuplicates(["doc_id"]), labels.distinct())
    assert (ranker.weights == once.weights).all() and ranker.threshold == once.threshold
    ties = quality.score(spark.createDataFrame([(1, A), (1, A), (2, A)], DOCS), ranker).collect()
    assert len({(r["score"], r["predicted"]) for r in ties}) == 1


def test_language_repeats(spark):
    rows = [(k, "the house and the garden", "en", "x") for k in range(40)] + [(k, "das haus und der garten", "de", "x") for k in range(20, 60)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, h string")
    many, once = language.fit(docs), language.fit(docs.distinct())
    assert many.langs == once.langs == ["de", "en"] and (many.logs == once.logs).all()
    got = language.predict(docs, many).collect()
    assert len(got) == 240 and {r["lang_pred"] for r in got} == {"de", "en"}
    empty = docs.limit(0)
    assert language.predict(docs, language.fit(empty)).where("lang_pred <> 'und'").isEmpty()
    assert language.keep_identified(empty).collect() == []


def test_line_repeats(spark):
    """Copies of one row are one place, however many they are."""
    line = "a line of more than fifty characters that stands in several texts"
    rows = [(1, f"x\n{line}")] * 50 + [(2, f"{line}\ny")] * 50 + [(2, "other")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).groupBy("doc_id", "text").count().collect()
    assert sorted(map(tuple, got)) == [(1, f"x\n{line}", 50), (2, "other", 1), (2, "y", 50)]


def test_query_repeats(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (4, [0.5, 3.0])]
    vectors = nearest.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, nearest.top_k(vectors, vectors.where("id = 0"), 5).collect()))
    assert got == sorted([(0, 1, 3, 2 * 65536), (0, 2, 4, 32768), (0, 1, 4, 3 * 65536), (0, 2, 3, 65536)])


def test_shards_of_odd_rows(spark):
    long = "word " * 300_000
    rows = [(2, long, "x"), (1, None, "y"), (1, None, "y"), (None, A, "z"), (3, "", "w")]
    docs = spark.createDataFrame(rows, DOCS + ", part string")
    got = sorted(map(tuple, token_ids.read_documents(token_ids.write_shards(docs, token_ids.word_bpe_path())).select("doc_id", "start", "n_tokens").collect()))
    assert got == [(1, 0, 1), (1, 1, 1), (2, 2, 300_001), (3, 300_003, 1)]


def test_scratch(spark):
    with common.scratch(spark):
        inner = common.materialize(spark.range(3), "inner")
        with common.scratch(spark):
            kept = common.materialize(spark.range(4), "kept", outlive=True)
            gone = common.materialize(spark.range(5), "gone").inputFiles()
        assert kept.count() == 4 and inner.count() == 3
        assert not any(Path(f.removeprefix("file:")).exists() for f in gone)
        files = inner.inputFiles() + kept.inputFiles()
    assert not any(Path(f.removeprefix("file://")).exists() for f in files)


def test_local_folder_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        common.shared_folder(Session())
