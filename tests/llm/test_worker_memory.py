"""What a worker holds at once does not follow the rows of a batch or the words of a corpus."""

import gc
import tracemalloc

import pyarrow as pa

from gridframe.llm import decontaminate, near_copies, pieces
from gridframe.llm.common import map_batches


def test_words_remembered_are_few_and_packed():
    """400,000 different words pass; before, 300,000 were kept, in lists of objects (a peak of 98 MB)."""
    templates = decontaminate.Templates()
    tracemalloc.start()
    for part in range(8):
        text = " ".join(f"word{part}x{k}" for k in range(50_000))
        assert len(templates.words([text])[1]) == 50_000
        del text
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 40 << 20 and peak < 60 << 20


def test_words_stay_right_when_forgotten():
    """A word has the same hash, kind and value before and after the worker starts anew."""
    templates, fresh = decontaminate.Templates(), decontaminate.Templates()
    text = "Natalia sold 48 clips to Her friends. Then 3 km more, (half) of THEM!"
    first = [x.tolist() for x in templates.words([text])]
    templates.words([" ".join(f"w{k}" for k in range(decontaminate.MAX_WORDS + 1))])
    templates.words(["fresh"])  # a new word, beyond what is remembered
    again = [x.tolist() for x in templates.words([text])]
    assert len(templates.known) < 20
    for own, entries in ((first, first[1]), (again, again[1])):
        assert own[0] == first[0] and own[2:] == first[2:]
    assert [templates.value[e] for e in again[1]] == [fresh.value[e] for e in fresh.words([text])[1]] == "natalia sold 48 clips to her friends then 3 km more half of them".split()


def test_batches_are_cut(spark):
    docs = spark.createDataFrame([(k, "a" * 1000) for k in range(5000)], "row long, text string").repartition(1)

    def run(batch: pa.RecordBatch) -> dict:
        return {"row": batch.column("row"), "n": [batch.num_rows] * batch.num_rows}

    whole, cut = (map_batches(docs, run, "row long, n long", *bound).collect() for bound in ((), (near_copies.READ_BYTES,)))
    assert max(r["n"] for r in whole) == 5000 and 500 < max(r["n"] for r in cut) < 1200
    assert sorted(r["row"] for r in cut) == list(range(5000))


def test_workers_drop_piece_models(spark, sf_dir):
    """After the ids of SentencePiece, workers with other work hold no model and none of its words."""
    assert pieces.query(spark, sf_dir).count() == 200

    def run(batches):
        for batch in batches:
            gc.collect()
            held = sum(isinstance(x, pieces.PieceModel) for x in gc.get_objects())
            yield pa.RecordBatch.from_pydict({"held": [held] * batch.num_rows})

    assert {r["held"] for r in spark.range(16).repartition(16).mapInArrow(run, "held long").collect()} == {0}
