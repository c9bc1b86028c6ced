"""Names at sentence starts and inserted words in benchmark items."""

from gridframe.llm import decontaminate

PRIYA = "Priya has 12 marbles and gives 5 to Ben. Priya buys 8 more. How many marbles does Priya have now?"
LONG = " ".join(f"word{chr(97 + k)}" for k in range(24))


def leaks(spark, docs, item):
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    return {r["doc_id"]: r for r in found.collect()}


def test_names_at_sentence_starts(spark):
    ravi = PRIYA.replace("Priya", "Ravi")
    docs = [(1, PRIYA), (2, ravi), (3, "Intro. " + ravi + " Then more."), (4, "By Priya. " + PRIYA), (5, "Priya likes tea. So does Priya.")]
    got = leaks(spark, docs, PRIYA)
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["n_matched"] == got[2]["n_matched"] == got[2]["n_windows"] == 13 and got[2]["n_exchanged"] == 1


def test_inserted_words(spark):
    words = LONG.split()
    docs = [(1, " ".join([*words[:12], "new", *words[12:]])), (2, " ".join(words[:11] + words[12:])), (3, " ".join([*words[:12], *"one of six other things is".split(), *words[12:]])), (4, " ".join(words[12:] + words[:12])), (5, " ".join(words[:13]))]
    got = leaks(spark, docs, LONG)
    assert {1, 2, 3} <= set(got) and not {4, 5} & set(got)
    assert got[1]["n_matched"] == 10 and got[1]["n_windows"] == 17
