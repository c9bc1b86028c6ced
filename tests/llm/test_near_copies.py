"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from gridframe.llm import near_copies, simhash
from gridframe.llm.common import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def brute(texts):
    """Ids that stay: the smallest of each component of pairs with similarity 0.8 or more."""
    sets = {}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    kept, seen = set(), set()
    for i in sorted(sets):
        if i in seen:
            continue
        kept.add(i)
        seen.add(i)
        queue = [i]
        while queue:
            a = sets[queue.pop()]
            near = [j for j in sets if j not in seen and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])]
            seen.update(near)
            queue += near
    return kept


def test_stage(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, far = {}, 0
    for g in range(40):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        texts[10 * g] = " ".join(words)
        for k in range(1, 6):  # a chain of changes: some pairs above 0.8, some below
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice((30, 45, 60, 100)))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[10 * g + k] = " ".join(words)
            far += (simhash.fingerprint(texts[10 * g + k]) ^ simhash.fingerprint(texts[10 * g + k - 1])).bit_count() > 4
    texts |= {900: "", 901: " ", 902: "two words", 903: "Two  words", 904: "two other"}
    want = brute(texts)
    assert far > 100 and 50 < len(want) < 200
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    assert all(r["text"] == texts[r["doc_id"]] for r in got)


def test_null_and_repeated_ids(spark, sf_dir):
    rng = random.Random(6)
    text = [" ".join(f"v{rng.randrange(3000)}" for _ in range(60)) for _ in range(5)]
    rows = [(None, text[0]), (None, text[1]), (7, text[1]), (3, text[2]), (3, text[2]), (3, text[3]), (None, text[4]), (None, text[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, text[0]), (7, text[1]), (3, text[2]), (3, text[3]), (0, text[4])])
    leak = read_table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    docs = docs.union(spark.createDataFrame([(None, f"Before it. {leak} After it.", "en", "s", 9)], SCHEMA))
    left = corpus_pipeline.decontaminate_benchmark(spark, docs, sf_dir).collect()
    assert len(left) == len(rows) and not any(leak in r["text"] for r in left)


def test_prefixes_lose_no_pair_and_boilerplate_meets_nobody(spark):
    rng = random.Random(8)
    common = rng.sample(range(10**6), 200)  # shingles of passages that many texts share
    sets = {}
    for family in range(30):
        base = set(rng.sample(range(10**6), rng.randint(3, 60))) | set(rng.sample(common, rng.randint(0, 40)))
        for _ in range(6):
            one = set(base)
            for _ in range(rng.randint(0, max(1, len(base) // 7))):
                one.discard(rng.choice(sorted(one)))
                one.add(rng.randrange(10**6))
            sets[len(sets)] = one
    group = range(1000, 1300)  # 60 shared shingles of 100 each: far from similar
    for k in group:
        sets[k] = set(common[:60]) | set(rng.sample(range(10**7, 10**8), 40))
    rows = [(k, len(v), k if k % 4 else -1, sorted(v)) for k, v in sets.items()]
    df = spark.createDataFrame(rows, "node long, n int, root long, shingles array<long>")
    pairs = {(r["a"], r["b"]) for r in near_copies.prefix_pairs(df.select("node", "n", "root"), df.select("node", "shingles"), 0.8).collect()}
    root = {k: r for k, _, r, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(want) > 100 and want <= pairs
    assert not any(a in group and b in group for a, b in pairs) and len(pairs) < 4 * len(want)
