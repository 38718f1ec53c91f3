import zlib

import numpy as np

import odd
from granary.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = X.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all() and (rows.predicted == (rows.score >= 0.7)).all()
    held = rows[rows.held_out]
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert len(toxic) > 100 and toxic.predicted.mean() > 0.8 and clean.predicted.mean() < 0.005


def test_scores_need_no_held_out_label_and_no_partitioning(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic", "quality")
    score = lambda d, l: {r.doc_id: r.score for r in X.toxicity_scores(d, l).collect()}  # noqa: E731, E741
    want = score(docs, labels)
    assert score(docs.repartition(7), other) == want


def plain(text):
    """Features one by one."""
    import re

    words = [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    h = [zlib.crc32(w.encode()) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    out = list(h) + [a * 3 + b * 0x1000193 for a, b in zip(h, h[1:])] + [a * 7 + b * 0x1000193 + 99 for a, b in zip(h, h[2:])]
    out += [zlib.crc32(w[:n].encode(), n) for w in words for n in X.BEGINNINGS if len(w) > n]
    return sorted({(v * 0x9E3779B97F4A7C15 % 2**64) >> (64 - X.BITS) for v in out})


def test_features_against_a_plain_model(monkeypatch):
    for text in ("", "one", "one two", "A bcdefgh A bcdefgh réeuxment ☃", "x-y.z " * 30):
        assert X.features(text.encode()).tolist() == plain(text)
    cut = X.common.term_pieces
    monkeypatch.setattr(X.common, "term_pieces", lambda t: cut(t, 16))
    text = "alpha beta gammadelta epsilon zeta eta theta iota kappa " * 9
    assert X.features(text.encode()).tolist() == plain(text)
    assert X.features(None).tolist() == []


def test_one_pass_against_a_plain_ftrl():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 40, 6)), int(rng.random() < 0.5)) for _ in range(200)]
    z, n = np.zeros(41), np.zeros(41)
    X.train(rows, z, n)
    pz, pn = {}, {}
    for x, y in rows:
        w = {}
        for i in [*x, 40]:
            a, b, free = pz.get(i, 0.0), pn.get(i, 0.0), i == 40
            l1, l2 = (0, 0) if free else (X.L1, X.L2)
            w[i] = 0.0 if abs(a) <= l1 else -(a - (l1 if a > 0 else -l1)) / ((X.BETA + b**0.5) / X.ALPHA + l2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in w:
            s = ((pn.get(i, 0.0) + g * g) ** 0.5 - pn.get(i, 0.0) ** 0.5) / X.ALPHA
            pz[i] = pz.get(i, 0.0) + g - s * w[i]
            pn[i] = pn.get(i, 0.0) + g * g
    assert np.allclose(z, [pz.get(i, 0.0) for i in range(41)]) and np.allclose(n, [pn.get(i, 0.0) for i in range(41)])


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (5, 0, 0, "x"), (None, 1, 1, "x"), (9, 0, None, "x"), (9, 1, 1, "x"), (77, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    rows = X.toxicity_scores(odd.docs(spark), labels).collect()
    assert len(rows) == len(odd.rows()) and all(0 <= r.score <= 1 for r in rows) and not [r for r in rows if r.doc_id is None and r.held_out]
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1 and len({r.score for r in rows if r.doc_id == 9}) == 1
    assert {r.score for r in X.toxicity_scores(odd.docs(spark), labels.limit(0)).collect()} == {0.5}
    assert X.toxicity_scores(odd.none(spark), labels).count() == 0
