"""Span trees, range joins, template keys and phrase automata against plain models, and what their plans hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from granary.operators import checks as C, ingest as I, traces as TR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tree_model(rows):
    by = {(t, s): (p, n or 0, c or 0.0) for t, s, p, n, c in rows}
    up = {k: (k[0], p) if p != k[1] and (k[0], p) in by else None for k, (p, *_) in by.items()}
    out = {k: [0, by[k][1], by[k][2], 0, 0, 0.0] for k in by}
    for k in by:
        path, at = [k], up[k]
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is not None:
            out[k][0] = None
            continue
        out[k][0] = len(path) - 1
        for a in path:
            out[a][3] += 1
            out[a][4] += by[k][1]
            out[a][5] += by[k][2]
    return {k: (v if v[0] is not None else [None, v[1], v[2], None, None, None]) for k, v in out.items()}


def test_span_trees(spark):
    rng = random.Random(3)
    rows = [(1, i, i - 1, 1, 0.5) for i in range(70)]  # a chain, whose first parent is missing
    rows += [(2, i, rng.choice([None, -5, *range(i)]) if i else None, rng.randint(0, 9), 0.25) for i in range(60)]  # a forest
    rows += [(3, 0, 0, 4, None), (3, 1, 2, 1, 1.0), (3, 2, 3, 1, 1.0), (3, 3, 1, None, 1.0), (3, 4, 3, 1, 1.0), (3, 5, 0, 2, 1.0)]  # a circle, one below it, and a span that is its own parent
    rows += [(4, 0, None, 7, 1.0), (5, 0, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "trace_id int, span_id int, parent_span_id int, tokens long, cost double").repartition(3)
    got = {(r.trace_id, r.span_id): [r.depth, r.tokens, r.cost, r.spans, r.all_tokens, r.all_cost] for r in TR.span_tree_totals(df).collect()}
    assert got == tree_model(rows)
    assert TR.span_tree_totals(df.limit(0)).count() == 0


def test_range_join_equals_the_array_form(spark):
    rng = random.Random(5)
    spans = [(d, i, s := rng.randint(0, 900), s + rng.randint(0, 400)) for d in range(12) for i in range(20)] + [(99, 0, 5, 9), (3, 77, None, 4)]
    bounds = []
    for d in range(12):
        at = rng.randint(0, 200)
        for p in range(1, rng.randint(1, 9)):
            size = rng.randint(0, 150)
            bounds.append((d, p, at, at + size))
            at += size + rng.randint(0, 60)
    s, b = spark.createDataFrame(spans, "doc_id int, span_id int, start int, end int"), spark.createDataFrame(bounds, "doc_id int, page int, start int, end int")
    arrays = s.join(b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "page"))).alias("b")), "doc_id", "left")
    none = F.array().cast("array<struct<start:int,end:int,page:int>>")
    want = {(r.doc_id, r.span_id): r.p for r in arrays.where("start IS NOT NULL").select("doc_id", "span_id", I.page_for_span(F.col("start"), F.col("end"), F.coalesce("b", none)).alias("p")).collect()}
    for size in (4096, 37):
        found = I.pages_of_spans(s, b, size)
        got = {(r.doc_id, r.span_id): r.page for r in found.collect()}
        assert got == want | {(3, 77): 1}
        assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_endpoints_meet_templates_by_key(spark):
    templates = ["/a/{id}", "/a/b", "/a/v{n}/x", "/{any}/c/{d}", "/long/{a}/{b}/{c}/end", "/lit.eral", "/q/{x}.html", None]
    known = spark.createDataFrame([(t,) for t in templates], "path string")
    paths = ["/a/7", "/a/b", "/a/v2/x", "/a/w2/x", "/z/c/9", "/z/d/9", "/long/1/2/3/end", "/long/1/2/end", "/lit-eral", "/a/{id}", "/q/z", "/A/7", "/a"]
    answers = spark.createDataFrame([(i, f"see {p} and {p} or {paths[(i + 3) % len(paths)]}.") for i, p in enumerate(paths)] + [(90, None), (91, "none")], "case_id int, answer string")
    rx = [re.compile("^" + re.sub(r"\\\{[^}]+\\\}", r"[^/\\s]+", re.escape(t)) + "$") for t in templates if t]
    token = re.compile(r"/[A-Za-z][A-Za-z0-9_\-{}]*(?:/[A-Za-z0-9_\-{}]+)*")
    want = sorted({(r.case_id, p) for r in answers.collect() if r.answer for p in token.findall(r.answer) if not any(x.match(p) for x in rx)})
    found = C.unknown_endpoints(answers, known)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 4
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_phrases_against_a_plain_search(spark, monkeypatch):
    rng = random.Random(8)
    phrases = [(i, "".join(rng.choice("ab. _é") for _ in range(rng.randint(1, 4))), rng.random() < 0.5) for i in range(60)] + [(60, "ab", True), (61, "ab", False), (62, "", True), (63, None, False)]
    texts = [(i, "".join(rng.choice("aab. _é") for _ in range(rng.randint(0, 25)))) for i in range(80)] + [(80, None), (81, "")]
    word = lambda c: c.isalnum() or c == "_"

    def whole(t, p):
        at = t.find(p)
        while at >= 0:
            end = at + len(p)
            if (at > 0 and word(t[at - 1])) != word(p[0]) and (end < len(t) and word(t[end])) != word(p[-1]):
                return True
            at = t.find(p, at + 1)
        return False

    want = {i: [n for n, p, w in phrases if p and t and (whole(t, p) if w else p in t)] for i, t in texts}
    df, ph = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(phrases, "phrase_no int, phrase string, whole boolean")
    for most in (500_000, 20):
        monkeypatch.setattr(C, "MOST_PHRASES", most)
        assert {r.id: r.hits for r in C.phrase_hits(df, ph).collect()} == want


def test_deprecations_of_ten_thousand_entries(spark):
    import time

    entries = [(i, [f"sym{i}", f"mod.fn{i}"], f"use `other{i}` instead") for i in range(10_000)] + [(10_001, [], "x"), (10_002, ["Plain"], None)]
    answers = [(1, "call sym7 now"), (2, "call SYM7 or other7"), (3, "xsym7 sym70x"), (4, "mod.fn9999, then sym3"), (5, None), (6, "plain words"), (7, "mod.fn12 sym13 other13")]
    d = spark.createDataFrame(entries, "entry int, symbols array<string>, note string")
    began = time.perf_counter()
    got = sorted(map(tuple, C.deprecation_violations(spark.createDataFrame(answers, "case_id int, answer string"), d).collect()))
    assert got == [(1, 7), (4, 3), (4, 9999), (6, 10_002), (7, 12)] and time.perf_counter() - began < 60
