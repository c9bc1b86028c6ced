"""Corpus pipeline: five stages over ``documents``, each kept as a table.

Language ID drops texts without an identified language; line dedup deletes later
copies of lines; of each component of near copies (similarity 0.8 by five-word
shingles) the first document stays; decontamination drops documents that hold a
benchmark item; SentencePiece gives each document that is left its ids and proves
that they decode to its text.

Defined results: documents with a null or empty text, or one without a letter, have no
language and go in the first stage; rows with a null id pass every stage by their text and
count last where the first of a group stays; of rows that repeat an id and text one
stays, of other texts of one id each is judged by itself; a text that line dedup empties is a
near copy of other empty texts, so one of them stays; very long texts are read whole; extra
columns stay until the last stage, whatever their names, unless they begin with two underscores;
ties are settled by id, then row; an empty table passes as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import decontaminate, language, line_dedup, near_copies, pieces
from gridframe.llm.common import materialize, read_table, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of lines."""
    return line_dedup.dedup_lines(docs).drop("__n_removed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similarity 0.8 or more, by five-word shingles.

    It is the one with the smallest id, null ids last; rows are told apart by a key of their
    own, so rows with a null id count like others and repeated rows leave one.
    """
    keyed = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    found = near_copies.near_copies(keyed.select(F.col("__row").alias("row"), "text"))
    ids = keyed.select("__row", F.col("doc_id").alias("__id"))
    found = materialize(found.join(ids, F.col("row") == F.col("__row")).select("row", "__id", "root"), "near-found")
    first = F.min(F.struct(F.col("__id").isNull(), "__id", "row").alias("f"))
    keep = found.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("__kept_row"))
    return keyed.join(keep, F.col("__row") == F.col("__kept_row"), "left_semi").drop("__row")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encode_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, as counts and a digest, and whether they decode to it."""
    return pieces.digest(docs, pieces.piece_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_sentencepiece),
]

#: The language model and the pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage writes for itself goes when its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", outlive=True)
    return docs
