import zlib

import numpy as np

import odd
from granary.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all() and (rows.predicted == (rows.score >= 0.3)).all()
    held = rows[rows.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.97


def test_scores_need_no_held_out_label(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    score = lambda l: {r.doc_id: round(r.score, 9) for r in Q.quality_scores(docs, l).collect()}  # noqa: E731, E741
    assert score(labels) == score(other)


def test_features_against_a_plain_model():
    held = np.sort([Q.hashing.number(w) for w in ("a", "b", "x", ".")])
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(len(held) + Q.SHARED, Q.DIM)).astype(np.float32)
    texts = [None, "", "one", "a b c. d!! " * 50, "x y " * 90_000, "z q r"]
    got = Q.features(texts, vectors, Q.hashing.Words(held, Q.SHARED))
    for t, x in zip(texts, got, strict=True):
        ids = [row(w, held.tolist()) for w in Q.hashing.TOKEN.findall(t or "")]
        v = vectors[ids].astype(float) if ids else np.zeros((0, Q.DIM))
        want = np.concatenate([v.mean(axis=0) if ids else np.zeros(Q.DIM), np.abs(np.diff(v, axis=0)).sum(axis=0) / max(1, len(ids) - 1) if ids else np.zeros(Q.DIM), [np.log1p(len(ids)) / 10]])
        assert np.allclose(x, want, atol=1e-3)


def row(word, held):
    n = Q.hashing.number(word)
    return held.index(n) if n in held else len(held) + n % Q.SHARED


def test_word_vectors_against_a_plain_model(spark, monkeypatch):
    texts = ["a b a c", "", "d", "b c " * 70_000, "a  b", "e b", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = {r.hash: r.n for r in Q.hashing.token_counts(docs).collect()}
    assert counts == {Q.hashing.number(w): n for w, n in {"a": 3, "b": 70_003, "c": 70_001, "d": 1, "e": 1}.items()}
    for most, tokens in ((Q.HELD, "abcde"), (3, "abc"), (1, "b")):  # rarer tokens share vectors
        monkeypatch.setattr(Q, "HELD", most)
        got = Q.word_vectors(docs)
        held = sorted((Q.hashing.number(w) for w in tokens), key=lambda h: (-counts[h], h))
        assert got.held.tolist() == held
        places, want = Q.index_vectors(np.array([*held, *range(Q.SHARED)])), np.zeros((len(held) + Q.SHARED, Q.DIM))
        assert all(len(set(p)) == Q.NONZERO for p in places.tolist())
        for t in texts:
            ids = [row(w, held) for w in (t or "").split()]
            for i, x in enumerate(ids):
                for y in ids[max(0, i - Q.WINDOW) : i] + ids[i + 1 : i + 1 + Q.WINDOW]:
                    for j, at in enumerate(places[y]):
                        want[x, at] += 1 if j < Q.NONZERO // 2 else -1
        norm = np.linalg.norm(want, axis=1, keepdims=True)
        assert np.allclose(got.vectors, want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (5, 0, 0, "x"), (None, 1, None, "x"), (9, None, 0, "x"), (9, 1, 0, "x"), (77, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    rows = Q.quality_scores(odd.docs(spark), labels).collect()
    assert len(rows) == len(odd.rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1 and len({r.score for r in rows if r.doc_id == 9}) == 1
    for some in (labels, labels.limit(0)):
        kept = Q.accepted(odd.docs(spark), some)
        assert kept.columns == odd.docs(spark).columns and kept.count() <= len(rows)
        assert Q.quality_scores(odd.none(spark), some).count() == 0


def test_a_repeated_labelled_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(50)] + [(2, "other words here"), (7, "more")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1)], "doc_id long, quality int")
    _, network = Q.fitted(docs, labels)
    assert len(network.mean) == 2 * Q.DIM + 1
    clash = docs.withColumn("granary_score", Q.F.lit("kept")).withColumn("score", Q.F.lit(1))
    assert Q.accepted(clash, labels, 0.0).columns == clash.columns and Q.accepted(clash, labels, 0.0).count() == 52
