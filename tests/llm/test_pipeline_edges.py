"""The whole pipeline on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import random

import pytest

import corpus_pipeline
from gridframe.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, row string, score string, component string"
ITEM = "Priya has 12 marbles and gives 5 of them to Ben and then she buys 8 more of the same kind"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = "the of and house garden river over under mountain small large green walks sees finds every morning evening people town street market bread water".split()
    text = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    german = lambda n: " ".join(rng.choices("der die das und haus garten fluss berg klein gross geht sieht findet jeden morgen abend leute stadt".split(), k=n))
    rows = [(k, text(60)) for k in range(30)] + [(100 + k, german(60)) for k in range(30)]
    long = " ".join(text(40) for _ in range(4000))
    rows += [(200, None), (201, ""), (202, "12 34 !!"), (203, long), (203, long), (None, rows[3][1]), (None, text(70)), (5, text(80)), (6, f"{text(30)} {ITEM}"), (3, rows[3][1]), (3, rows[3][1]), (204, f"{text(30)} {ITEM} {text(30)}"), (None, f"{text(20)} {ITEM.replace('12', '40')}")]
    full = [(i, t, "de" if i is not None and 100 <= i < 200 else "en", "s", len(t) if t else 0, "x", "y", "z", "w") for i, t in rows]
    out = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows


def test_edges(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, path), name)
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()] if "text" in docs.columns else docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
    named = kept["language_id"]
    assert len(named) == len(rows) - 3 and {None, 3, 203, 204} <= {i for i, _ in named} and not {200, 201, 202} & {i for i, _ in named}
    assert len(kept["line_dedup"]) == len(named)
    after = kept["near_duplicates"]
    assert sum(i == 203 for i, _ in after) == 1 and sum(i == 3 for i, _ in after) == 1 and sum(i is None for i, _ in after) == 2
    assert sum(i == 5 for i, _ in after) == sum(i == 6 for i, _ in after) == 2  # other texts of one id
    clean = kept["decontamination"]
    assert sum(i == 6 for i, _ in clean) == 1
    assert len(clean) == len(after) - 3 and not any("marbles" in t for _, t in clean)
    assert len(kept["sentencepiece"]) == len(clean) and all(r["round_trip"] for r in kept["sentencepiece"])


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_leaves_only_stage_tables(spark, folder, monkeypatch, tmp_path):
    from gridframe.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() > 0
    left = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "gridframe").iterdir())
    assert left == sorted(f"stage-{name}" for name, _ in corpus_pipeline.STAGES)
