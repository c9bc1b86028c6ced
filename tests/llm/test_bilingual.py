"""Documents of several languages stay in the pipeline's language stage."""

import corpus_pipeline
from gridframe.llm import language
from gridframe.llm.common import read_table


def test_bilingual_documents_stay(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    words = {}
    for r in docs.where("lang is not null and length(text) > 400").orderBy("doc_id").collect():
        words.setdefault(r["lang"], r["text"].split())
    langs = sorted(words)
    assert len(langs) >= 3
    schema = docs.schema
    mixed = [(10_000 + k, "\n".join(" ".join(words[x][:40]) for x in group), None, "s", 0) for k, group in enumerate([langs[:2], langs[1:3], langs[:3], langs])]
    mixed.append((10_100, "12 34 56", None, "s", 0))
    more = docs.union(spark.createDataFrame(mixed, schema))
    scores = {r["doc_id"]: r["score"] for r in language.predict(more, language.fit(more)).where("doc_id >= 10000").collect()}
    assert sum(scores[10_000 + k] < language.MIN_SCORE for k in range(4)) >= 2  # what the share alone would reject
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, more, sf_dir).where("doc_id >= 10000").collect()}
    assert kept == {10_000, 10_001, 10_002, 10_003}
