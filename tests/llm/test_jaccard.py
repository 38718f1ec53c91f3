import random
import re

import odd
from granary.llm import graphs, jaccard as J


def grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def model(docs):
    sets = [grams(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def corpus(seed, groups=6, size=90):
    """Groups of near copies, some beyond a column's short length, with a passage that many share and chains of drift."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage, docs = [word() for _ in range(55)], []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([8, 40, 120, 200]))]
        for _ in range(rng.choice([2, 7, size])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            docs.append(w)
            if g == 0:
                base = w  # drift
    for _ in range(60):
        docs.append([word() for _ in range(rng.randint(5, 80))] + passage + [word() for _ in range(rng.randint(0, 40))])
    docs += [[], ["one"], ["one"], ["one", "two"]]
    rng.shuffle(docs)
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def test_brute_force(spark):
    for seed in (1, 2, 3):
        docs = corpus(seed)
        got = sorted(map(tuple, J.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()))
        assert got == sorted(model(docs))


def test_odd_rows(spark):
    got = sorted(map(tuple, J.components(odd.docs(spark)).collect()), key=str)
    known = {r[0]: r for r in got if r[0] is not None}
    assert len(got) == len(odd.rows()) and known[6][2] == known[1][2] == 1 and known[8][2] == known[7][2] == 7 and known[2] == (2, 0, 2) and known[4] == (4, 0, 4)
    kept = J.one_of_each(odd.docs(spark))
    assert kept.columns == odd.docs(spark).columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 9, 9, 10, 11, 11]
    assert J.components(odd.none(spark)).count() == 0


def test_words_are_cut_at_six_characters():
    assert len(J.gram_set("a\x0bb\x0cc\td\re f".encode())) == 2 and len(J.gram_set("a\x1cb\xa0c\x85d".encode())) == 1
    assert J.gram_set("ÄB c".encode()).tolist() != J.gram_set("äb c".encode()).tolist() and J.gram_set(b"AB C").tolist() == J.gram_set(b"ab c").tolist()


def test_different_sets_of_one_number_are_told_apart(spark):
    docs = corpus(4, groups=3, size=20)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for bits in (3, 8):
        seen, classes, split = J.told_apart(rows, bits)
        assert split and classes.count() == len({frozenset(g) for _, t in docs if (g := grams(t))})
        assert sorted(map(tuple, J.components(rows, bits=bits).collect())) == sorted(model(docs))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 60)] + [(5, 5), (61, 62), (61, 62)]
    random.Random(1).shuffle(chain)
    links = spark.createDataFrame(chain, "a long, b long").repartition(6)
    got = {r.node: r.comp for r in graphs.connected_components(links).collect()}
    assert got == {r.node: r.comp for r in graphs.connected_components(links, hot_rows=10).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(7, 60), 7), 61: 61, 62: 61}


def test_bounds_lose_no_pair():
    rng = random.Random(8)
    for _ in range(300):
        x = set(rng.sample(range(300), rng.randint(1, 60)))
        y = set(x)
        for _ in range(rng.randint(0, 8)):
            (y.discard if rng.random() < 0.5 else y.add)(rng.choice(range(300)))
        if not y or 100 * len(x & y) < 75 * len(x | y):
            continue
        small, large = sorted((x, y), key=len)
        a, b = sorted(small), sorted(large)
        i, p = J._shares(0.75, len(a))[0], J._shares(0.75, len(b))[1]
        assert set(a[:i]) & set(b[:p])
        both = set(a[: J._shares(0.75, len(a))[1]]) & set(b[:p])
        import numpy as np

        assert len(both) >= J._shortfall(np.array(len(a)), np.array(len(b)), 0.75)


def test_near_copies_without_ids(spark):
    words = [f"w{i}" for i in range(120)]
    near = lambda at, base=words: " ".join(base[:at] + ["other"] + base[at + 1 :])
    far = [f"v{i}" for i in range(120)]
    docs = [(None, " ".join(words)), (None, near(30)), (None, near(0, far)), (4, near(119, far)), (9, near(60, far)), (11, "alone here")]
    got = sorted(map(tuple, J.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == sorted([(None, 116, None), (None, 116, None), (None, 116, 4), (4, 116, 4), (9, 116, 4), (11, 1, 11)], key=str)


def test_one_of_each_goes_by_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "x")
    other = " ".join(f"v{i}" for i in range(60))
    far = other.replace("v5 ", "y ")
    kept = lambda rows: sorted(map(tuple, J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert kept([(3, text), (11, text), (11, "a text of its own")]) == sorted([(3, text), (11, "a text of its own")], key=str)
    assert kept([(3, text), (11, near), (11, other), (12, far)]) == sorted([(3, text), (11, other)], key=str)
    assert kept([(None, text), (3, near), (4, None), (None, ""), (None, None)]) == sorted([(3, near), (4, None), (None, ""), (None, None)], key=str)
    alone = kept([(None, text), (None, near), (None, other)])
    assert len(alone) == 2 and (None, other) in alone
    same = kept([(3, text), (3, near), (9, far), (9, far)])
    assert len(same) == 3 and same.count((9, far)) == 2


def test_product_of_a_block(monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(J, "PIECE_PAIRS", 50)
    rng = np.random.default_rng(1)
    for _ in range(20):
        classes, sizes = rng.integers(-(2**62), 2**62, rng.integers(1, 60)), rng.integers(1, 12, 60)
        rows = int(rng.integers(1, 900))
        keys, which = rng.choice(rng.integers(0, 2**63, max(1, rows // 6), dtype=np.uint64), rows), rng.integers(0, len(classes), rows)
        packed = []
        for lo, hi in ((0, rows // 2), (rows // 2, rows)):
            used, local = np.unique(which[lo:hi], return_inverse=True)
            packed.append((keys[lo:hi].tobytes(), bytes(hi - lo), local.astype("<u2").tobytes(), classes[used].tobytes(), sizes[used].astype("<i4").tobytes()))
        made = J._product(pd.DataFrame(packed, columns=["keys", "flags", "local", "classes", "sizes"]), 0.75)
        columns, want, size = {}, {}, dict(zip(classes.tolist(), sizes.tolist()))
        for k, c in set(zip(keys.tolist(), classes[which].tolist())):
            columns.setdefault(k, []).append(c)
        for cs in columns.values():
            for a in cs if len(cs) <= J.SHORT else ():
                for b in cs:
                    if a < b and min(size[a], size[b]) >= 0.75 * max(size[a], size[b]):
                        want[a, b] = want.get((a, b), 0) + 1
        pairs = made[made.kind == 0]
        assert {(a, b): n for a, b, n in zip(pairs.a, pairs.b, pairs.n) if n} == want and not pairs.duplicated(["a", "b"]).any()
        assert all((size[a], size[b]) == (x, y) for a, b, x, y in zip(pairs.a, pairs.b, pairs.na, pairs.nb))


def _column(spark, rows, t=0.75):
    """second_pairs() of rows (class, size, flag, long rows, component) that stand in one long column."""
    made = spark.createDataFrame([(1, a, 77, n, flag, 0, 0) for a, n, flag, _, _ in rows], J.PRODUCT)
    long = spark.createDataFrame([(a, r) for a, _, _, r, _ in rows], "node long, rows long")
    comps = spark.createDataFrame([(a, c) for a, *_, c in rows], "node long, comp long")
    return J.second_pairs(made, long, comps, t)


def test_large_columns_give_the_pairs_that_the_bounds_allow(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(12)
    rows = [(a, rng.choice([1, 2, 3, 9, 10, 40, 41, 50, 200]) + rng.randint(0, 4), rng.randint(0, 3), rng.choice([1, 2, 5, 30]), rng.randint(0, 60)) for a in range(180)]
    e = np.array([(a, c, n, f, r) for a, n, f, r, c in rows], np.int64).T
    want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if J._allowed(e[:, [i]], e[:, [j]], 0.75)[0]}
    assert len(want) > 50
    got = {}
    for chunk, band, pairs in ((1024, 1 << 14, 1 << 20), (8, 1 << 14, 1 << 20), (8, 5, 7)):
        monkeypatch.setattr(J, "LONG_CHUNK", chunk)
        monkeypatch.setattr(J, "BAND_ROWS", band)
        monkeypatch.setattr(J, "WINDOW_PAIRS", pairs)
        got = {(r.a, r.b) for r in _column(spark, rows).collect()}
        assert got == want


def test_a_large_column_without_pairs_takes_time_in_proportion(spark):
    import time

    from pyspark.sql import functions as F

    def took(n):
        made = spark.range(n).select(F.lit(1).alias("kind"), F.col("id").alias("a"), F.lit(77).cast("long").alias("b"), F.lit(60).cast("long").alias("n"), F.lit(3).alias("flag"), F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"))
        made = J.common.written(made, "column")
        long = J.common.written(made.select(F.col("a").alias("node"), F.lit(1).cast("long").alias("rows")), "long")
        comps = J.common.written(made.select(F.col("a").alias("node"), F.col("a").alias("comp")), "comps")
        began = time.perf_counter()
        assert J.second_pairs(made, long, comps, 0.75).count() == 0
        return time.perf_counter() - began

    took(1_000)
    half, whole = took(250_000), took(500_000)
    assert whole < 3 * half + 5 and whole < 60


def test_common_grams_stay_within_their_limit(spark, monkeypatch):
    """300 n-grams of 20,000 each: the topmost step alone is over the limit."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(J, "COMMON_KEPT", 10)
    for n in (5, 20_000, 5_000_000):
        seen = spark.range(300).select(F.lit(1).alias("kind"), F.xxhash64("id").alias("cls"), F.lit(n).cast("long").alias("n"))
        kept, counts = J.common_grams(seen)
        assert 0 < len(kept) <= 10 and set(counts.tolist()) == {n}
    mixed = spark.range(300).select(F.lit(1).alias("kind"), F.xxhash64("id").alias("cls"), F.when(F.col("id") < 4, 10**9 + F.col("id") * 10**8).otherwise(3).cast("long").alias("n"))
    assert sorted(J.common_grams(mixed)[1].tolist()) == [10**9 + i * 10**8 for i in range(4)]
