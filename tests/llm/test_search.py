import math
import random
import re
from collections import Counter

import pytest

import odd
from granary.llm import search as S


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, k):
    bags = [(i, Counter(terms(x))) for i, x in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    big_n, big_l = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m, score = 75 + 25 * n * big_n // big_l, 0
            for t, times in Counter(terms(text)).items():
                if b[t]:
                    score += times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m))
            if score > 0:
                scored.append((-score, -(10**18) if i is None else i, i))
        out += [(item, r + 1, s[2], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:2])[:k])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "x9"]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(len(words))], k=rng.randint(0, 40)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(25)] + [(98, "absent"), (99, None), (5, "w3, W3 w1")]
    return docs, items


@pytest.mark.parametrize(("tiers", "candidates", "k"), [((2, 8), 2000, 3), ((4, 16), 5, 3), ((1000,), 2000, 20), ((5, 20, 80), 40, 1)])
def test_against_a_plain_model_in_every_tier(spark, monkeypatch, tiers, candidates, k):
    monkeypatch.setattr(S, "TIERS", tiers)
    monkeypatch.setattr(S, "CANDIDATES", candidates)
    docs, items = corpus(len(tiers), 300)
    d, q = spark.createDataFrame(docs + [(None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain([(r.doc_id, r.text) for r in d.collect()], items, k)
    got = sorted((tuple(r) for r in S.search(d.repartition(3), q, k).collect()), key=repr)
    assert got == want


def test_questions_are_proved_in_upper_tiers_and_fall_through(spark, monkeypatch):
    monkeypatch.setattr(S, "TIERS", (8, 40))
    # 'rare' stands in few documents, so the first tier holds all its postings; 'same' is alike everywhere, so no tier cuts it
    docs = [(i, "rare " * (1 + i % 3) + "same") for i in range(6)] + [(100 + i, "same other") for i in range(200)] + [(400 + i, "mid " * (30 if i < 20 else 1) + "pad " * (i % 7)) for i in range(150)]
    items = spark.createDataFrame([(1, "rare"), (2, "rare same"), (3, "mid"), (4, "same other")], "item_id long, text string")
    asked = S.Asked(S.asked_terms(items).collect())
    best, proved = S._block(spark.createDataFrame(docs, "doc_id long, text string"), asked, 5)
    tier = {asked.items[i][1]: int(t) for i, t in enumerate(proved)}
    assert tier[1] == 0 and tier[3] < 2 and 0 <= min(tier.values())
    got = sorted(((asked.items[r["item"]][1], r["rank"], r.doc_id, r.score) for r in best.collect()), key=repr)
    assert got == plain(docs, [(r.item_id, r.text) for r in items.collect()], 5)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 12)
    docs, items = corpus(9, 80)
    got = sorted((tuple(r) for r in S.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4).collect()), key=repr)
    assert got == plain(docs, items, 4)


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "the fox", 3), (None, "one TWO", 4), (2, "", 5), (3, "é 4041894974608795", 6)], "item_id long, text string, score int")
    got = sorted((tuple(r) for r in S.search(odd.docs(spark), items).collect()), key=repr)
    assert got == plain([(r[0], r[1]) for r in odd.rows()], [(r[0], r[1]) for r in items.collect()], 20)
    assert S.search(odd.none(spark), items).count() == 0 and S.search(odd.docs(spark), items.limit(0)).count() == 0
