"""The quality model against plain computations over every training row and every pair."""

import zlib

import numpy as np
import pytest

from gridframe.llm import quality
from gridframe.llm.common import read_table


def training_rows(docs, labels):
    """Features and labels of the rows that are learnt, found one by one."""
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = sorted({(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1})
    return np.array([quality.features(texts[k]) for k, _ in known]), np.array([q == 1 for _, q in known])


@pytest.mark.parametrize("block_rows", [5, quality.BLOCK_ROWS])
def test_model_of_all_pairs(spark, sf_dir, block_rows):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    x, good = training_rows(docs, labels)
    ranker = quality.fit(docs, labels, block_rows)
    assert np.allclose(ranker.mean, x.mean(axis=0)) and np.allclose(ranker.spread, x.std(axis=0) + 1e-6)
    assert np.allclose(ranker.knots, np.quantile((x - ranker.mean) / ranker.spread, quality.KNOTS, axis=0))
    table = ranker.expand(x)
    d = (table[good][:, None, :] - table[~good][None, :, :]).reshape(-1, table.shape[1])
    slope = quality.RIDGE * ranker.weights - (d / (1 + np.exp(d @ ranker.weights))[:, None]).mean(axis=0)
    assert np.abs(slope).max() < 1e-6
    raw = np.sort(ranker.raw(x))
    n_bad = int((~good).sum())
    assert ranker.threshold == (raw[n_bad - 1] + raw[n_bad]) / 2
    again = quality.fit(docs.repartition(5), labels.repartition(3), block_rows)
    assert (again.weights == ranker.weights).all() and again.threshold == ranker.threshold


def test_no_row_is_left_out(spark):
    """More rows of a label than any sample had: each one counts in the model."""
    docs = spark.range(18_000).selectExpr("id as doc_id", "concat('word ', id, repeat(' more', int(id % 7)), if(id % 2 = 0, ' !', '')) as text")
    labels = spark.range(18_000).selectExpr("id as doc_id", "int(id % 2) as quality", "0 as toxic")
    x, good = training_rows(docs, labels)
    assert min(good.sum(), (~good).sum()) > 5_000
    ranker = quality.fit(docs, labels, 4_096)
    assert np.allclose(ranker.mean, x.mean(axis=0), rtol=1e-12) and np.allclose(ranker.spread, x.std(axis=0) + 1e-6)
    raw = np.sort(ranker.raw(x))
    assert ranker.threshold == (raw[(~good).sum() - 1] + raw[(~good).sum()]) / 2


def test_different_texts_of_one_id(spark):
    """Each different text of an id is learnt, repeated ones once."""
    texts = [(7, "plain words here"), (7, "plain words here"), (7, "OTHER $$$ !!!"), (8, "bad # bad"), (9, "good and fine text")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    kept = [t for t in dict.fromkeys(texts) if zlib.crc32(str(t[0]).encode()) % 3 != 1]
    ranker = quality.fit(docs, labels)
    assert len({i for i, _ in kept}) == 3
    assert np.allclose(ranker.mean, np.mean([quality.features(t) for _, t in kept], axis=0))


def test_exact_selection():
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=999), np.repeat([-0.0, 0.0, 5e-324], 333), rng.normal(size=999) * 1e300], axis=1)
    good = rng.random(999) < 0.4
    for rank in (0, 400, 998):
        got = quality.select(lambda part, merge: part(x, good), lambda t: t, [0, 1, 2], [lambda b, g: b + g > rank] * 3)
        assert (got == np.sort(x, axis=0)[rank]).all()
