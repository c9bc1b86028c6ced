"""Every stage against brute force on its own input, and the whole run."""

from test_near_copies import brute

import corpus_pipeline
from gridframe.llm import decontaminate, language, line_dedup
from gridframe.llm.common import materialize, read_table


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = materialize(stage(spark, docs, sf_dir), name)
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "sentencepiece":
            assert set(after) == set(before) and all(r["round_trip"] for r in after.values())
            break
        assert out.columns == columns and set(after) <= set(before)
        if name == "language_id":
            kept = {r["doc_id"] for r in language.predict(docs, language.fit(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= language.MIN_SCORE}
            assert set(after) == kept and len(kept) > 0.95 * len(before)
        elif name == "line_dedup":
            assert set(after) == set(before)
            seen = set()
            for doc_id in sorted(before):
                for line in before[doc_id]["text"].split("\n"):
                    if len(line) + 1 >= line_dedup.MIN_CHARS:
                        assert (line in after[doc_id]["text"].split("\n")) or line in seen
                        seen.add(line)
            left = [x for r in after.values() for x in r["text"].split("\n") if len(x) + 1 >= line_dedup.MIN_CHARS]
            assert len(left) == len(set(left)) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near_duplicates":
            assert set(after) == brute({i: r["text"] for i, r in before.items()})
        else:
            bad = {r["doc_id"] for r in decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark")).collect()}
            assert set(after) == set(before) - bad
        docs = out


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.where("not round_trip").isEmpty()


def test_clashing_columns(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = read_table(spark, sf_dir, "documents").select("*", *[F.lit(1).alias(n) for n in ("id", "row", "line", "component", "gone", "score")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert "component" in docs.columns and docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
