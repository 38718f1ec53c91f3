from collections import Counter, defaultdict

import odd
from granary.llm import mixing


def model_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        add = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += add[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_takes(spark):
    docs = [(i, "w " * (1 + i * 7 % 50), ["a", "b", "c", "d", None][min(i % 11, 4)]) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    sizes, taken, target = Counter(), Counter(), {}
    source = {i: s for i, _, s in docs}
    for r in rows:
        assert r["size"] == 1 + r.doc_id * 7 % 50 and 0 <= r.taken <= 2 * r["size"]
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    want = model_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and taken[s] == int(target[s] + 1e-9)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_odd_rows(spark):
    rows = mixing.mix(odd.docs(spark)).collect()
    assert len(rows) == len(odd.rows())
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[2][0]["size"] == by[3][0]["size"] == by[4][0]["size"] == 0 and by[5][0]["size"] == 160_000
    assert len(by[9]) == 2 and mixing.mix(odd.none(spark)).count() == 0


def test_schedule(spark):
    df = odd.docs(spark)
    out = mixing.schedule(df)
    assert out.columns == df.columns
    taken = Counter(r.doc_id for r in out.collect())
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[r.doc_id] += -(-r.taken // r["size"]) if r["size"] else 0
    assert taken == +copies and mixing.schedule(odd.none(spark)).count() == 0


def test_taken_is_what_the_sorted_mix_gives(spark):
    """Packets by finish time, one after the other until the budget is used up."""
    docs = [(i, "w " * (1 + i * 13 % 90), "abc"[i % 7 % 3]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    ends = {r.doc_id: r.finish * r.target for r in rows}
    queue = []
    for r in rows:
        for copy in range(2):
            end = round(ends[r.doc_id]) + copy * r.source_size
            marks = [end - r["size"], *([int(r.target)] if end - r["size"] < int(r.target) < end else []), end]
            queue += [(hi / r.target, r.doc_id, hi - lo) for lo, hi in zip(marks, marks[1:])]
    left, taken = sum(int(t) for t in {r.source_size: r.target for r in rows}.values()), Counter()
    for _, doc, words in sorted(queue):
        taken[doc] += min(words, max(0, left))
        left -= words
    assert {r.doc_id: r.taken for r in rows} == {d: taken[d] for d, _, _ in docs}


def test_the_cut_falls_into_a_packet(spark):
    queue = spark.createDataFrame([(i, 0, True, 10, i / 100) for i in range(100)], "row long, copy int, opens boolean, words long, finish double").repartition(3)
    for budget, want in ((0, []), (5, [5]), (10, [10]), (333, [10] * 33 + [3]), (1000, [10] * 100), (5000, [10] * 100)):
        got = sorted((r.row, r.words) for r in mixing.cut_at(queue, budget).collect())
        assert [w for _, w in got] == want and [i for i, _ in got] == list(range(len(want)))


def test_hot_ids_are_cut_up(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = [(None if i % 2 else 7, "w " * (1 + i % 9), "ab"[i % 3 % 2]) for i in range(900)] + [(100 + i, "w w", "b") for i in range(50)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.source_size, r.target] += r.taken
    assert len(rows) == 950 and all(n == int(t) for (_, t), n in by.items())


def test_schedule_loses_no_row(spark):
    """Rows alike in id, source and text but not in another column, and rows alike in all."""
    docs = [(1, "a b c", "en", "s"), (1, "a b c", "fr", "s"), (1, "a b c", "fr", "s"), (2, "d e", "en", "t"), (None, "f g", "en", "t"), (None, "f g", "de", "t"), (2, "h i j k", "en", "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    out = Counter(map(tuple, mixing.schedule(df).collect()))
    assert set(out) == set(docs) and out[1, "a b c", "fr", "s"] >= out[1, "a b c", "en", "s"]
    # with a budget of twice all words every row is there twice
    twice = Counter(map(tuple, mixing.schedule(df, share=2.0).collect()))
    assert twice == Counter(docs * 2)
