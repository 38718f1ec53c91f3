import random
import re

import odd
from granary.llm import decontaminate as D


def grams(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def item_grams(text):
    return grams(text, min(5, len(re.findall(r"[^\W_]+", (text or "").lower())))) - {""}


def test_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 12, 33, 40])))) for i in range(40)]
    items += [(50 + i, " ".join(f"own{i}{j}" for j in range(1 + i % 4))) for i in range(8)]
    docs = []
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            if rng.random() < 0.5 and len(part) > 8:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((i, ", ".join(words).title() if i % 3 else " ".join(words)))
    docs += [(200 + i, items[i][1]) for i in range(5)]
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in D.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        own = set().union(*(grams(t, n) for n in range(1, 6)))
        for i, x in items:
            g = item_grams(x)
            if g and len(g & own) >= 0.75 * len(g):
                want[d, i] = (len(g), len(g & own))
    assert got == want and len(want) > 30 and {len(items_of.split()) for _, items_of in items if any((d, i) in want for d, _ in docs for i, x in items if x == items_of)} >= {1, 2, 3, 4, 5}


def test_short_items_inside_long_documents(spark):
    docs = spark.createDataFrame([(1, "we would like to Visit New-York today and then go home again " * 30), (2, "visit new york"), (3, "visit old york today " * 50), (4, "today")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "visit new york today"), (2, "today"), (3, "visit new york"), (4, "new york today and then go home")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contained(docs, items).collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 3), (3, 2), (4, 2)}


def test_clean_rows_stay_beside_leaking_ones_of_their_id(spark):
    leak, good = "one two three four five six seven", "nothing of the kind is said here at all"
    docs = [(None, leak), (None, good), (5, leak), (5, good), (5, good), (6, None), (7, "")]
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    got = D.clean(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, good), (5, good), (5, good), (6, None), (7, "")], key=str)


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", "x"), (None, "fairly long", "x"), (3, None, "x"), (4, "", "x"), (5, "One two", "x"), (6, "alpha beta gamma delta alpha beta", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in D.contained(odd.docs(spark), items).collect()}
    assert got == {(1, 1), (6, 1), (7, 5), (8, 5), (5, 6), (None, None)}  # the two words of the item without an id are inside the text without one
    kept = D.clean(odd.docs(spark), items)
    assert kept.columns == odd.docs(spark).columns and sorted(r.doc_id or -1 for r in kept.collect()) == [2, 3, 4, 9, 9, 10, 11, 11]
    assert D.contained(odd.none(spark), items).count() == 0 and D.contained(odd.docs(spark), items.limit(0)).count() == 0


def test_native_plan(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over")], "item_id long, text string")
    plan = D.contained(odd.docs(spark), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
