"""Pairs of the rows of a group: all of them, once, in tasks of a like size whatever the group."""

from collections import defaultdict

from granary.operators import evaluation as E


def _plain(rows):
    groups = defaultdict(set)
    for item, s, page in rows:
        if s is not None and page is not None:
            groups[s, page].add(item)
    return sorted({(a, b) for g in groups.values() for a in g for b in g})


def _got(spark, rows):
    return sorted(tuple(r) for r in E.pairs_within(spark.createDataFrame(rows, "item long, s string, page long"), ["s", "page"]).collect())


def test_pairs_are_whole_and_distinct(spark, monkeypatch):
    monkeypatch.setattr(E, "PAIR_ROWS", 8)
    rows = [(i, "" if i % 2 else f"s{i % 5}", i % 3) for i in range(120)]
    rows += [(1, "", 1), (1, "s1", 1), (4, "s1", 1), (4, "", 1), (7, None, 1), (500, "alone", None)]  # repeated rows, items of several groups, null keys
    got = _got(spark, rows)
    assert got == _plain(rows) and len(got) == len(set(got))
    assert _got(spark, rows[:120]) == _plain(rows[:120]) and _got(spark, rows[:0]) == []


def test_a_large_group_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "PAIR_ROWS", 50)
    rows = spark.range(600).selectExpr("id AS item", "'' AS s", "0L AS page")
    sizes = [r[0] for r in E.pairs_within(rows, ["s", "page"]).rdd.mapPartitions(lambda it: [(sum(1 for _ in it),)]).collect()]
    assert sum(sizes) == 600 * 600 and max(sizes) < 600 * 600 / 10
