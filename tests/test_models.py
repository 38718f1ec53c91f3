"""Operators against plain Python models, and their edge cases."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from granary.functions import text as T, vectors as V
from granary.operators import checks, evaluation as E, ingest as I, retrieval as R
from granary.plans import config as C
from granary.streaming import stateful as SS

SIZE, OVERLAP = 40, 12


def model_pieces(text, start=0, seps=("\n\n", "\n", " ", "")):
    if not text:
        return []
    if len(text) <= SIZE or not seps:
        return [(start, text)]
    if seps[0] == "":
        return [(start + i, c) for i, c in enumerate(text)]
    out, at = [], 0
    for part in text.split(seps[0]):
        if part:
            out += model_pieces(part, start + at, seps[1:])
        at += len(part) + len(seps[0])
    return out


def model_chunks(text, overlap):
    out, cur = [], []
    total = lambda ps: sum(len(t) for _, t in ps)
    close = lambda ps: (" ".join(t for _, t in ps).strip(), ps[0][0], ps[-1][0] + len(ps[-1][1]))
    for piece in model_pieces(text):
        if cur and total(cur) + len(piece[1]) > SIZE:
            out.append(close(cur))
            kept = []
            if overlap:
                for p in reversed(cur):
                    if kept and total(kept) + len(p[1]) > overlap:
                        break
                    kept.insert(0, p)
            cur = kept
        cur.append(piece)
    return out + ([close(cur)] if cur else [])


def texts(n, seed):
    rng = random.Random(seed)
    made = ["", " ", "a" * 200, "word " * 30, "x\n\n\ny"]
    for _ in range(n):
        made.append("".join(rng.choice(["w", "word", "longerword" * rng.randint(1, 6), " ", "\n", "\n\n"]) for _ in range(rng.randint(1, 60))))
    return made


@pytest.mark.parametrize("overlap", [0, OVERLAP])
def test_chunks_equal_the_model(spark, overlap):
    rows = list(enumerate(texts(60, 3)))
    got = spark.createDataFrame(rows, "id int, t string").select("id", I.chunk_text(F.col("t"), SIZE, overlap).alias("c")).collect()
    for r in got:
        assert [(x.t, x.start, x.end) for x in r.c] == model_chunks(rows[r.id][1], overlap), rows[r.id]


def test_sections_carry_short_bodies(spark):
    doc = "Preamble text.\n# One\nshort\n# Two\n" + "long body " * 8 + "\nSummary\n# Three\nx"
    rows = I.sections(spark.createDataFrame([(1, doc), (2, "no heading at all."), (3, "# Only"), (4, "")], "doc_id int, content string")).orderBy("doc_id", "section_no").collect()
    one = [(r.section, r.start, r.text) for r in rows if r.doc_id == 1]
    assert [s for s, _, _ in one] == [None, "Two"]
    assert one[1][1] == doc.index("# One") and "".join(t for _, _, t in one) == doc
    assert [(r.section, r.text) for r in rows if r.doc_id == 2] == [(None, "no heading at all.")]
    assert [(r.section, r.text) for r in rows if r.doc_id == 3] == [(None, "# Only")]
    assert [r.text for r in rows if r.doc_id == 4] == [""]


def test_ingest_offsets_and_ids(spark):
    doc = "Intro words here.\n# Big Heading\n" + "alpha beta gamma delta " * 60 + "• first item • second item"
    df = spark.createDataFrame([(7, doc)], "doc_id int, content string")
    rows = I.ingest_chunks(df).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) and {r.page for r in rows} == {1}
    assert all(r.token_count >= 1 and 0 <= r.start <= r.end <= len(doc) for r in rows)
    assert sorted(r.chunk_id for r in rows) == sorted(r.chunk_id for r in I.ingest_chunks(df).collect())
    total = I.document_summary(df, I.ingest_chunks(df), F.lit(False)).first()
    assert total["size"] == len(doc.encode()) and total.embedding_error.startswith("no embedding")


def model_ndcg(items, expected, k=10):
    claimed, dcg = set(), 0.0
    for i, item in enumerate(items[:k]):
        for j, e in enumerate(expected):
            if j not in claimed and item & e:
                claimed.add(j)
                dcg += 1 / math.log2(i + 2)
                break
    ideal = sum(1 / math.log2(i + 2) for i in range(min(len(expected), k)))
    return round(dcg / ideal, 4) if ideal else 0.0


def test_ndcg_equals_the_greedy_model(spark):
    rng = random.Random(5)
    cases = {q: ([{rng.choice("abcdef") for _ in range(rng.randint(1, 2))} for _ in range(rng.randint(1, 12))], [{rng.choice("abcdef")} for _ in range(rng.randint(1, 5))]) for q in range(40)}
    ret = spark.createDataFrame([(q, i + 1, sorted(x)) for q, (r, _) in cases.items() for i, x in enumerate(r)], "query_id int, rank long, keys array<string>")
    exp = spark.createDataFrame([(q, i, sorted(x)) for q, (_, e) in cases.items() for i, x in enumerate(e)], "query_id int, exp_no long, keys array<string>")
    for r in E.ir_metrics(ret, exp).collect():
        items, expected = cases[r.query_id]
        assert r.ndcg == pytest.approx(model_ndcg(items, expected), abs=1e-4)
        assert r.recall == pytest.approx(sum(any(i & e for i in items) for e in expected) / len(expected), abs=1e-4)


def model_admit(times, limit, seconds):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if k > t - seconds]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def test_rate_limit_equals_the_model_and_the_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, i % 3, f"2024-01-01 00:{rng.randint(0, 9):02d}:{rng.randint(0, 59):02d}") for i in range(120)]
    df = spark.createDataFrame(rows, "request_id long, client long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.request_id: r.admitted for r in SS.rate_limit(df, 2, 60).collect()}
    secs = lambda s: int(s[14:16]) * 60 + int(s[17:])
    for c in range(3):
        own = sorted((secs(t), i) for i, k, t in rows if k == c)
        assert [got[i] for _, i in own] == model_admit([t for t, _ in own], 2, 60)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    SS.run_available(SS.rate_limit_stream(stream, 2, 60), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert {r.request_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == got
    odd = [(1, None, "2024-01-01 00:00:00"), (2, None, "2024-01-01 00:00:01"), (3, None, "2024-01-01 00:01:00"), (4, "a", None), (5, "a", None), (6, "a", "2024-01-01 00:00:00")]
    rows = spark.createDataFrame(odd, "request_id long, client string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(map(tuple, SS.rate_limit(rows, 1, 60).collect())) == [(1, None, True), (2, None, False), (3, None, True), (4, "a", True), (5, "a", True), (6, "a", True)]
    assert SS.rate_limit(rows.limit(0), 1).count() == 0 and not any(r.admitted for r in SS.rate_limit(rows, 0).collect())


def ranked(spark, rows):
    return spark.createDataFrame([(0, c, c, float(-r), r) for r, c in enumerate(rows, 1)] or [(0, 0, 0, 0.0, 1)], "query_id int, chunk_id long, pos long, score double, rank long").where(F.lit(bool(rows)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 12), unique=True, max_size=8), st.lists(st.integers(0, 12), unique=True, max_size=8))
def test_fusion_and_interleave_equal_the_models(spark, left, right):
    fused = R.rrf_fusion(ranked(spark, left), ranked(spark, right)).orderBy("rank").collect()
    score = {c: sum(1 / (60 + xs.index(c) + 1) for xs in (left, right) if c in xs) for c in {*left, *right}}
    order = sorted(score, key=lambda c: (-round(score[c], 9), left.index(c) if c in left else 10**9, right.index(c) if c in right else 0))
    assert [r.chunk_id for r in fused] == order
    mixed, want = R.interleave(ranked(spark, left), ranked(spark, right), 5).orderBy("rank").collect(), []
    for i in range(8):
        for xs in (left, right):
            if i < len(xs) and xs[i] not in want:
                want.append(xs[i])
    assert [r.chunk_id for r in mixed] == want[:5]


def test_vectors_guard_odd_input(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.dot(F.col("a"), F.col("b")).alias("d"), V.l2(F.col("a"), F.col("b")).alias("l")).collect()
    assert [r.c for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0] and [r.d for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.l for r in got][:4] == [0.0, math.inf, math.inf, math.inf]


def test_bm25_counts_repeats_and_empty_documents(spark):
    docs = spark.createDataFrame([(0, 0, "apple apple pear"), (1, 1, "apple"), (2, 2, ""), (3, 3, None), (4, 4, "fig fig"), (5, 5, "plum")], "chunk_id long, pos long, content string")
    q = spark.createDataFrame([(1, "apple"), (2, "apple apple"), (3, "the what is"), (4, "")], "query_id int, query string")
    rows = {(r.query_id, r.chunk_id): r.score for r in R.bm25_search(q, docs, 10).collect()}
    n, avgdl = 6, 7 / 6
    idf = math.log((n - 2 + 0.5) / 2.5) + 1
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl))
    assert rows[1, 0] == pytest.approx(want, abs=1e-6) and rows[2, 0] == pytest.approx(2 * want, abs=2e-6)
    assert not any(k[0] in (3, 4) for k in rows)
    moved = docs.orderBy(F.desc("pos")).repartition(3)
    assert {(r.query_id, r.chunk_id): r.score for r in R.bm25_search(q, moved, 10).collect()} == rows


def test_threshold_of_distances(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id int, embedding array<float>")
    c = spark.createDataFrame([(i, i, [float(i), 0.0]) for i in range(4)], "chunk_id long, pos long, embedding array<float>")
    ids = lambda t: [r.chunk_id for r in R.vector_search(q, c, 10, "l2", t).orderBy("rank").collect()]
    assert ids(0.0) == [0, 1, 2, 3] and ids(-1.5) == [2, 3]


def test_mmr_with_missing_vectors_and_ties(spark):
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "chunk_id long, embedding array<float>")
    cand = spark.createDataFrame([(1, i, i, 1.0, i + 1) for i in range(4)], "query_id int, chunk_id long, pos long, score double, rank long")
    rows = R.mmr(cand, c, final_count=3).collect()
    chosen = [r.chunk_id for r in sorted((r for r in rows if r.selected), key=lambda r: r["rank"])]
    assert chosen == [0, 2, 3] and [r.chunk_id for r in rows if not r.selected] == [1]


def test_config_widths_and_overrides():
    c = C.default_config("hybrid-rerank-mmr", 5)
    assert (c.vector.top_k, c.reranker.top_n, c.mmr.final_count, c.rrf.top_n) == (20, 15, 5, 5) and c.runs("mmr")
    assert not c.overridden(mmr=C.MmrConfig(lambda_=0.1)).runs("mmr")
    with pytest.raises(ValueError):
        C.RetrievalConfig("nearest")


def test_status_ladder(spark):
    rows = [(0.0, 0.0, 0, 0, "x", None), (1.0, 1.0, 1, 1, "x", "boom"), (0.0, 0.0, 1, 3, "x", None), (0.0, 0.0, 1, 0, "x", None), (1.0, 1.0, 1, 1, " ", None), (1.0, 0.9995, 2, 1, "x", None), (1.0, 0.5, 2, 1, "x", None)]
    df = spark.createDataFrame(rows, "h double, r double, e int, n int, a string, x string")
    s, f = E.case_status(*(F.col(c) for c in "hrenax"))
    assert [tuple(r) for r in df.select(s, f).collect()] == [("not_run", None), ("failed", "llm_failure"), ("failed", "missing_source"), ("failed", "retrieval_failure"), ("failed", "prompt_issue"), ("passed", None), ("partial", "poor_ranking")]


def test_page_for_span_prefers_the_first(spark):
    b = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(p).alias("page")) for s, e, p in ((0, 10, 1), (11, 21, 2), (22, 30, 3))))
    rows = spark.createDataFrame([(0, 5), (5, 16), (9, 21), (100, 110)], "s int, e int").select(I.page_for_span(F.col("s"), F.col("e"), b).alias("p"), I.page_for_span(F.col("s"), F.col("e"), F.array().cast("array<struct<start:int,end:int,page:int>>")).alias("none")).collect()
    assert [r.p for r in rows] == [1, 1, 2, 1] and {r.none for r in rows} == {1}


def test_empty_tables(spark):
    chunks = spark.createDataFrame([], "chunk_id long, pos long, content string, embedding array<float>")
    q = spark.createDataFrame([(1, "apple")], "query_id int, query string")
    assert R.bm25_search(q, chunks, 5).count() == 0
    assert R.vector_search(spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>"), chunks, 5).count() == 0
    assert I.ingest_chunks(spark.createDataFrame([], "doc_id long, content string")).count() == 0
    assert E.average_metrics(spark.createDataFrame([], ", ".join(f"{m} double" for m in E.METRICS))).first().recall == 0.0


def test_text_helpers(spark):
    row = spark.range(1).select(
        T.token_estimate(F.lit("")).alias("none"), T.token_estimate(F.lit("one two three")).alias("three"), T.document_stem(F.lit("a/b/.hidden")).alias("dot"), T.document_stem(F.lit("x.tar.gz")).alias("stem"),
        T.document_key(F.lit(" Guide.PDF ")).alias("key"), T.clean_keyword(F.lit("'a'")).alias("short"), checks.path_pattern(F.lit("/a/{b}/c.d")).alias("path"),
    ).first()
    assert (row.none, row.three, row.dot, row.stem, row.key, row.short, row.path) == (0, 4, ".hidden", "x.tar", "guide", None, r"^/a/[^/\s]+/c\.d$")


def test_labels_without_a_case_are_dropped(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1)], "case_id int, label int")
    cases = spark.createDataFrame([(1, "passed"), (2, "failed"), (3, "passed")], "case_id int, status string")
    assert sorted(map(tuple, E.labelled(labels, cases).collect())) == [(1, 1, "passed"), (2, 0, "failed")]


def test_upper_median_by_position(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 10, 11):
        values = [rng.randint(0, 5) + rng.random() for _ in range(n)]
        got = spark.createDataFrame([(v,) for v in values], "v double").agg(E.upper_median("v").alias("m")).first().m
        assert got == sorted(values)[n // 2]


def test_chunks_of_a_page_are_on_it(spark):
    pages = [f"Page {i} " + f"word{i} " * 40 for i in range(6)]
    df = spark.createDataFrame([(1, "\n".join(pages), pages)], "doc_id int, content string, pages array<string>")
    for r in I.ingest_chunks(df, 120, 0).collect():
        at = [sum(len(p) + 1 for p in pages[:i]) for i in range(6)]
        overlap = [min(r.end, at[i] + len(pages[i])) - max(r.start, at[i]) for i in range(6)]
        assert r.page == 1 + overlap.index(max(overlap))


def test_offsets_of_parts(spark):
    rows = [(1, ["ab", "", "cde"]), (2, []), (3, None), (4, ["x"])]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, p array<string>").select("i", I.starts(F.col("p"), 2).alias("s")).collect()}
    assert got == {1: [0, 4, 6], 2: [], 3: None, 4: [0]}


def test_long_texts_are_chunked_in_linear_time(spark):
    import time

    began = time.perf_counter()
    chunks = I.chunks_of("ab " * 400_000 + "x" * 200_000, 512, 64)
    assert time.perf_counter() - began < 20 and chunks[-1]["end"] == 1_400_000


def test_documents_that_hold_a_query(spark):
    from granary.sources import adapters

    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "x"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for i in range(30)] + [(90, "pha beta gam"), (91, "ta"), (92, "beta  gamma")]
    got = {(r.query_id, r.chunk_id) for r in adapters.holders(spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")).collect()}
    assert got == {(q, d) for q, s in queries for d, t in docs if s in t}


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        T.tokens(F.lit("x"), "unheard of")
    vectors = spark.createDataFrame([(1, 1, [1.0])], "chunk_id int, pos int, embedding array<double>")
    with pytest.raises(ValueError):
        R.vector_search(vectors.select(F.col("chunk_id").alias("query_id"), "embedding"), vectors, 1, "unheard of")
