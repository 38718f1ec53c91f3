"""Blocked nearest neighbours against all pairs one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import nearest as N, retrieval as R


def score(a, b, kind):
    if len(a) != len(b):
        return -math.inf if kind == "l2" else 0.0
    a, b = np.array(a, float), np.array(b, float)
    if kind == "l2":
        return round(-float(np.sqrt(((a - b) ** 2).sum())), 6)
    s = float(a @ b)
    if kind == "cosine":
        n = np.linalg.norm(a) * np.linalg.norm(b)
        s = s / n if n else 0.0
    return round(s, 6) + 0.0


def tables(spark, n=700, d=5):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, d)) * 4
    vectors = [np.round(centres[i % 9] + rng.normal(size=d) * 0.2, 3).tolist() for i in range(n)]
    vectors[5], vectors[6], vectors[7], vectors[8], vectors[9] = None, [], [1.0, 2.0], [0.0] * d, vectors[10]
    questions = [np.round(centres[i] * 0.9, 3).tolist() for i in range(6)] + [[0.0] * d, [1.0, 1.0], None, []]
    c = [(f"c{i}", n - i, v) for i, v in enumerate(vectors)]
    q = list(enumerate(questions))
    return c, q, spark.createDataFrame(c, "chunk_id string, pos int, embedding array<double>").repartition(3), spark.createDataFrame(q, "query_id int, embedding array<double>")


@pytest.mark.parametrize("kind", N.KINDS)
@pytest.mark.parametrize(("k", "least"), [(4, None), (3, 0.5), (None, -1.5)])
@pytest.mark.parametrize("at_once", [4096, 2])
def test_against_all_pairs(spark, monkeypatch, kind, k, least, at_once):
    monkeypatch.setattr(N, "QUESTIONS", at_once)
    c, q, chunks, queries = tables(spark)
    least = -least if least and kind == "l2" else least
    want = {}
    for i, v in q:
        if not v:
            continue
        rows = sorted(((-score(v, e, kind), pos, x) for x, pos, e in c if e), key=lambda r: r[:2])
        rows = [r for r in rows if least is None or (-r[0] <= least if kind == "l2" else -r[0] >= least)]
        want |= {(i, x): -s for s, _, x in rows[:k]}
    got = {(r.query_id, r.chunk_id): r.score for r in R.ranked(N.nearest(queries, chunks, k, kind, least), k).collect()}
    assert set(got) == set(want) and all(got[x] == want[x] or abs(got[x] - want[x]) < 2e-6 for x in got)


@pytest.mark.parametrize("kind", N.KINDS)
def test_blocks_out_of_reach_are_skipped(kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 5
    c = centres[np.arange(8192) % 8] + rng.normal(size=(8192, 16)) * 0.05
    q = centres[:3] + 0.01
    if kind == "cosine":
        c, q = N.unit(c), N.unit(q)
    n = N.Nearest(q, kind, 10, None)
    for lo in range(0, len(c), 2048):
        n.add(c[lo : lo + 2048], np.arange(lo, lo + 2048), np.arange(lo, lo + 2048))
    assert n.skipped > 0.5 * n.blocks
    s = N.scores(q, c, kind)
    for i in range(3):
        best = np.lexsort((np.arange(len(c)), -s[i]))[:10]
        assert n.row[n.of == i].tolist() == best.tolist()


def test_rows_that_fell_out_are_forgotten(spark):
    df = spark.range(150_000).select(F.col("id").alias("chunk_id"), F.col("id").alias("pos"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding")).coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r.chunk_id for r in R.ranked(N.nearest(q, df, 3, "dot"), 3).orderBy("rank").collect()] == [149_999, 149_998, 149_997]


def test_a_registered_similarity(spark, monkeypatch):
    monkeypatch.setitem(R.SIMILARITIES, "first", lambda q, c, qn, cn: F.get(q, F.lit(0)) * F.get(c, F.lit(0)))
    c = spark.createDataFrame([(i, i, [float(i), 1.0]) for i in range(5)], "chunk_id int, pos int, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<double>")
    assert [(r.chunk_id, r.score) for r in R.vector_search(q, c, 2, "first").orderBy("rank").collect()] == [(4, 8.0), (3, 6.0)]
