"""The quality ranking and the word scores of language ID against plain computations."""

import numpy as np

from gridframe.llm import language, quality
from gridframe.llm.common import read_table


def test_ranker_is_near_the_optimum():
    """Logistic loss over all preference pairs: as low as plain descent on all of them gets it."""
    rng = np.random.default_rng(2)
    good = rng.random(120) < 0.6
    x = rng.normal(size=(120, 4)) + np.outer(good, [0.8, -0.5, 0.0, 0.3])
    ranker = quality.Ranker(x, good, float(good.mean()))
    table = ranker.expand(x)
    d = (table[good][:, None, :] - table[~good][None, :, :]).reshape(-1, table.shape[1])

    def loss(w):
        return float(np.logaddexp(0, -(d @ w)).mean() + 5e-4 * (w @ w))

    w = np.zeros(table.shape[1])
    for _ in range(3000):
        w = w + 0.3 * ((d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) - 1e-3 * w)
    assert loss(ranker.weights) <= loss(w) + 0.02
    assert loss(ranker.weights) < loss(np.zeros_like(w)) - 0.1


def test_threshold_is_the_quantile():
    """As many training rows are below the threshold as there are bad labels, and the score is 0.5 there."""
    rng = np.random.default_rng(3)
    good = rng.random(400) < 0.7
    x = rng.normal(size=(400, 3)) + good[:, None]
    ranker = quality.Ranker(x, good, float(good.mean()))
    below = (ranker.expand(x) @ ranker.weights < ranker.threshold).mean()
    assert abs(below - (1 - good.mean())) <= 1 / 400 + 1e-9
    assert ((ranker.score(x) >= 0.5) == (ranker.expand(x) @ ranker.weights >= ranker.threshold)).all()


def test_features_of_plain_counts():
    text = "One two two, THREE!\n\nfour 5 | # 50%"
    f = quality.features(text)
    words = text.split()
    assert f[0] == np.log1p(len(text)) and f[-1] == 0.0
    assert f[1] * len(text) == sum(c.isupper() for c in text) and f[3] * len(text) == sum(c.isdigit() for c in text)
    assert f[19] == len(text) / len(words) and f[20] == len(set(words)) / len(words)
    assert quality.features("")[0] == 0.0 and len(quality.features("")) == len(f)


def test_word_scores_are_those_of_n_grams(spark, sf_dir):
    """Log shares of n-grams counted one by one, over learned languages."""
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit(docs)
    usable = [r for r in docs.collect() if r["lang"] and language_rows(r["doc_id"])]
    counts = {lang: {} for lang in model.langs}
    totals = {lang: [0, 0, 0, 0] for lang in model.langs}
    for r in usable:
        for word in (r["text"] or "").split():
            word = language.letters(word)
            for n in (1, 2, 3) if word else ():
                padded = f"^{word}$"
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    counts[r["lang"]][g] = counts[r["lang"]].get(g, 0) + 1
                    totals[r["lang"]][n] += 1
    kinds = {n: len({g for c in counts.values() for g in c if len(g) == n}) for n in (1, 2, 3)}
    for word in ("thing", "straße", "niño", "qzxw"):
        padded, want = f"^{word}$", []
        for lang in model.langs:
            s = 0.0
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    s += np.log((counts[lang].get(padded[i : i + n], 0) + 0.5) / (totals[lang][n] + 0.5 * kinds[n]))
            want.append(s)
        want = np.array(want) - max(want)
        want = np.maximum(want - np.log(np.exp(want).sum()), language.FLOOR)
        model.learn({word})
        assert np.allclose(model.table[model.known[word]], want, atol=1e-6), word


def language_rows(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 != 2
