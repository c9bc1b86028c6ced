"""Case, insertions, chance windows, classes of items, the shuffle, and recall over changed items."""

import itertools
import random

import pytest

from gridframe.llm import decontaminate
from gridframe.llm.common import read_table

ITEM = "Natalia sold 48 clips to her friends in April and then she sold half as many clips in May for 3 km"


def leaks(spark, docs, items, **options):
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    return {(r["doc_id"], r["item_id"]): r for r in found.collect()}


def test_other_case(spark):
    docs = [(1, ITEM.lower()), (2, ITEM.upper()), (3, ITEM.title()), (4, "Intro of it. " + ITEM.lower().replace("48", "96") + " and so on")]
    got = leaks(spark, docs, [(7, ITEM)])
    assert {d for d, _ in got} == {1, 2, 3, 4}
    assert all(got[d, 7]["coverage"] == 1 for d in (1, 2, 4)) and got[1, 7]["n_exchanged"] == 0 and got[4, 7]["n_exchanged"] == 1


def test_insertions(spark):
    words = ITEM.replace("Natalia", "Robert").split()
    docs = [(1, " ".join([*words[:10], "just", "about", *words[10:]])), (2, " ".join([*words[:9], "so", *words[9:]])), (3, " ".join(words[:7]))]
    got = leaks(spark, docs, [(7, ITEM)])
    assert {d for d, _ in got} == {1, 2}


def test_chance_window_does_not_poison(spark):
    """A window that pairs a slot otherwise comes first, and does not outvote the rest."""
    start = "Natalia sold 12 clips to her friends in Bern"
    got = leaks(spark, [(1, start + " . " + ITEM.replace("48", "96").replace("Natalia", "Robert"))], [(7, ITEM)])
    assert got[1, 7]["coverage"] == 1


def test_inconsistent_slots(spark):
    item = "a train of 12 cars and 12 seats goes to 12 towns where 12 people get in and 12 get out of it again"
    docs = [(1, item.replace("12", "40")), (2, "a train of 3 cars and 4 seats goes to 5 towns where 6 people get in and 7 get out of it again")]
    assert {d for d, _ in leaks(spark, docs, [(7, item)])} == {1}


def test_classes_of_items(spark):
    """Items that differ in values are one class; the shuffle finds what the broadcast does."""
    items = [(5, ITEM), (3, ITEM.replace("48", "50")), (9, ITEM), (8, "another item of enough words that nobody has in any text of his"), (4, "too short"), (6, None), (None, ITEM)]
    docs = [(1, ITEM), (2, "x " + ITEM.replace("48", "7").upper()), (2, "other text of the same id"), (3, ITEM), (3, ITEM), (4, ""), (5, None), (None, ITEM)]
    want = {(d, 3) for d in (1, 2, 3)}
    got = leaks(spark, docs, items)
    assert set(got) == want and all(r["n_items"] == 3 for r in got.values())
    assert leaks(spark, docs, items, broadcast_windows=0) == got
    assert leaks(spark, docs, [], broadcast_windows=0) == leaks(spark, [], items, broadcast_windows=0) == {}


def test_windows_are_all_pairs():
    """Windows of documents that meet an item are those whose template words agree one by one."""
    rng = random.Random(3)
    words = ["Anna", "Bob", "12", "3", "km", "the", "The", "red", "runs", "to.", "Mia", "and", "€5", "five"]
    for _ in range(200):
        doc, item = (" ".join(rng.choices(words, k=rng.randrange(6, 40))) for _ in range(2))
        readings = decontaminate.item_readings(decontaminate.Templates(), item, 4)
        bench = decontaminate.Benchmark([{"item_id": 1, "n_items": 1, "readings": readings}])
        got = set()
        for size, (known, table) in bench.sizes.items():
            for _, _, place, h, mine in decontaminate.text_windows(decontaminate.Templates(), [doc], size, lambda f: f == f, known):
                got |= {(number, k, place, mine) for number, k, _, _ in table[h]}
        want = set()
        own = decontaminate.Templates().readings([doc])
        for n, (_, hashes, slots, entry, places, other) in enumerate(own):
            values = decontaminate.Templates()
            values.readings([doc])
            for p in range(len(hashes) - 3):
                if n and not other[p : p + 4].any():
                    continue
                for number, r in enumerate(readings):
                    _, theirs, *_ = decontaminate.Templates().readings([item])[number]
                    for k in range(len(theirs) - 3):
                        if all(hashes[p + j] == theirs[k + j] for j in range(4)):
                            want.add((number, k, int(places[p]), tuple(values.value[e] for e in entry[p : p + 4][slots[p : p + 4]])))
        assert got == want


def test_alignment_is_near_the_best():
    """Against every choice of windows and values: never more, and hardly less where all of them compete."""
    rng = random.Random(8)
    for _ in range(300):
        hits = []
        for k in range(6):
            for _ in range(rng.randrange(1, 3)):
                hits.append((k, k, rng.choice([k + 5, k + 6]), (rng.choice("ab"),), (rng.choice("xy"),)))
        best = 0
        for some in itertools.chain.from_iterable(itertools.combinations(hits, n) for n in range(1, 7)):
            pairs = {(h[3][0], h[4][0]) for h in some}
            if all(a[0] < b[0] and a[2] < b[2] for a, b in zip(some, some[1:])) and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                best = max(best, len(some))
        got = len(decontaminate.aligned(hits)[0])
        assert best - 2 <= got <= best
        plain = [(k, k, k + 5, (), ()) for k in range(6)]
        assert decontaminate.aligned(plain)[0] == set(range(6))


def test_short_items(spark):
    """Under 6 template words the run of all words counts, under 3 words a whole text."""
    items = [(1, "Olga bakes 24 muffins."), (2, "Thank you"), (3, "2 + 2 = 4"), (4, "..."), (5, "What is the capital of France?")]
    docs = [
        (1, "Some text. Olga bakes 24 muffins. More text."), (2, "OLGA BAKES 24 MUFFINS"), (3, "Olga bakes 25 muffins."), (4, "Olga often bakes 24 muffins."), (5, "Thank you for it"), (6, "thank you!"), (7, "2 + 2 = 4"),
        (8, "they say 2 2 4 and go"), (9, "What is the capital of Spain?"), (10, "He asked: what is the capital of France? Nobody knew."), (11, "Olga bakes 24"), (12, "..."),
    ]
    want = {(1, 1), (2, 1), (6, 2), (7, 3), (8, 3), (10, 5)}
    got = leaks(spark, docs, items)
    assert set(got) == want and all(r["coverage"] == 1 and r["n_exchanged"] == 0 for r in got.values())
    assert leaks(spark, docs, items, broadcast_windows=0) == got


def test_names_in_lower_case(spark):
    item = "Priya has 12 marbles and gives 5 to Ben. Priya buys 8 more. How many marbles does Priya have now?"
    doc = "ravi has 31 marbles and gives 7 to tom. ravi buys 9 more. how many marbles does ravi have now?"
    mixed = doc.replace("does ravi", "does omar")  # not the same name throughout
    docs = [(1, doc), (2, "Some text. " + doc.upper() + " Some more."), (3, "Ravi likes it. " + doc), (4, "the weather has turned and gives way to rain. nobody buys it any more. how many days does it have now?")]
    got = leaks(spark, [*docs, (5, mixed)], [(7, item)])
    assert {d for d, _ in got} in ({1, 2, 3}, {1, 2, 3, 5}) and got[1, 7]["coverage"] > 0.9 and got[1, 7]["n_exchanged"] == 5
    assert leaks(spark, [*docs, (5, mixed)], [(7, item)], broadcast_windows=0) == got


FIRST = "Priya Ravi Mei Omar Zoe Ingrid Bjarne Chidi Nkechi Hiro Yuki Fatima Ahmed Svetla Dragan Paloma Xochitl Kwame Aiyana Tariq".split()
THINGS = "marbles apples stamps ribbons lamps pencils tickets coins shells buttons".split()
PLOTS = [
    "{a} has {x} {t} and gives {y} of them to {b}. Then {a} buys {z} more {t} at the shop. How many {t} does {a} have now?",
    "On Monday {a} and {b} packed {x} boxes with {y} {t} each. If {b} takes {z} {t} home, how many {t} are left for {a}?",
    "A shop sells {x} {t} for {y} dollars. How much does {a} pay for {z} {t} if {b} pays half of the price?",
    "After {a} found {x} {t} in the garden, {b} found {y} times as many. Together {a} and {b} sold {z} {t}. How many {t} did they keep?",
]


@pytest.mark.parametrize("broadcast_windows", [decontaminate.BROADCAST_WINDOWS, 0])
def test_recall_and_precision(spark, broadcast_windows):
    """240 items with names that no list has, exchanged with the numbers, in normal, lower and upper case; other questions with the same words stay."""
    rng = random.Random(6)
    items, docs, want = [], [], set()
    fill = lambda plot, thing, lo: plot.format(**dict(zip("ab", rng.sample(FIRST, 2))), **dict(zip("xyz", map(str, rng.sample(range(lo, lo + 80), 3)))), t=thing)
    for n in range(240):
        plot, thing = PLOTS[n % 4], f"{THINGS[n // 4 % 10]} {n // 40}q{n // 4 % 10}"  # an item of its own each
        items.append((n, fill(plot, thing, 2)))
        body = fill(plot, thing, 100)
        body = [body, body.lower(), body.upper()][n % 3]
        docs.append((n, f"Before it stands this. {body} And after it this."))
        want.add((n, n))
    clean = [
        "What is the capital of {a}? It is what {b} would ask about {t} of {x} towns.", "{a} counts {t} in the garden every day. Then {b} comes and they talk about the weather for {x} minutes.",
        "many shops sell {t} at some price. on monday they are closed. nobody knows how much {a} pays there or why {b} is late.", "HOW MANY {t} ARE THERE? THE GARDEN OF {a} HAS SOME. TOGETHER THEY KEEP WHAT {b} LEAVES.",
    ]
    docs += [(1000 + n, fill(clean[n % 4], rng.choice(THINGS), 3)) for n in range(240)]
    got = set(leaks(spark, docs, items, broadcast_windows=broadcast_windows))
    own = {d for d, i in got if (d, i) in want}
    by_case = [sum(d % 3 == c for d in own) / 80 for c in range(3)]
    false = sorted({d for d, _ in got if d >= 1000})
    print("recall in normal, lower and upper case", by_case, "clean documents found", len(false), "of 240")
    assert min(by_case) >= 0.9 and not false


@pytest.mark.parametrize("broadcast_windows", [decontaminate.BROADCAST_WINDOWS, 0])
def test_recall(spark, broadcast_windows):
    """Items with numbers and names, in documents that exchange them, insert words and change case."""
    rng = random.Random(6)
    names = ["Alice", "Bob", "Carol", "Priya", "Ravi"]
    items, docs, want = [], [], set()
    texts = [r["text"] for r in read_table(spark, "/root/testdata/sf0.01", "benchmark").orderBy("item_id").collect() if r["text"] and len(r["text"].split()) >= 14]
    for n, text in enumerate(texts):
        item, doc = [], []
        values = {}
        lower = n % 4 == 1
        other = ["Frank", "Grace", "Mei", "Omar", "Zoe"]
        for k, word in enumerate(text.split()):
            if k % 5 == 3:
                a = rng.choice([str(rng.randrange(2, 9)), rng.choice(names)])
                b = values.setdefault(a, str(rng.randrange(100, 999) * 10 + len(values)) if a.isdigit() else next(x for x in rng.sample(other, 5) if x not in values.values()))
                item.append(a)
                doc.append(b)
            else:
                item.append(word)
                doc.append(word)
        items.append((n, " ".join(item)))
        if n % 3 == 0:
            doc.insert(len(doc) // 2, "indeed")
        body = " ".join(doc)
        docs.append((n, f"Before it stands this. {body.lower() if lower else body} And after it this."))
        want.add((n, n))
    docs += [(1000 + n, " ".join(rng.sample(text.split(), len(text.split())))) for n, text in enumerate(texts)]
    got = set(leaks(spark, docs, items, broadcast_windows=broadcast_windows))
    recall = len(got & want) / len(want)
    assert recall >= 0.9 and not got - want, recall
    print("recall", recall, len(want))
