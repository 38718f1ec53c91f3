import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

import odd
from granary.llm import resample as R


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n, least, percent):
    s, t = Counter(b for _, x in docs for b in runs(x, n)), Counter(b for x in target for b in runs(x, n))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, x in docs:
        f = runs(x, n)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least])
    best = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -(10**18) if r[0] is None else r[0]))
    for k, r in enumerate(best[: percent * len(best) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("n", "long", "chunk"), [(2, 1 << 16, 1 << 15), (2, 40, 16), (3, 30, 1), (1, 10, 7)])
def test_against_a_plain_model(spark, monkeypatch, n, long, chunk):
    monkeypatch.setattr(R, "LONG", long)
    monkeypatch.setattr(R, "CHUNK", chunk)
    docs = [(r[0], r[1]) for r in odd.rows()] + [(100 + i, f"Alpha beta, gamma {i} réé delta-{i % 3} " * (1 + i % 7)) for i in range(30)]
    target = ["alpha beta gamma", None, "", "réé delta réé", "x " * 60]
    df, want = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in R.resample(df.repartition(5), want, n=n, least_words=4, percent=40).collect()), key=repr)
    assert got == plain(docs, target, n, 4, 40)


def test_chunks_lose_and_repeat_no_run():
    text = ("one Two three-four fiveé " * 40 + "x" * 50).encode()
    for n in (1, 2, 3, 5):
        for size in (1, 7, 64, 10_000):
            parts = list(R.chunks(text, n, size))
            assert b"".join(p[0] for p in parts) == text
            assert sorted(b for p in parts for b in R.feature_buckets(*p, n)[1].tolist()) == sorted(runs(text.decode(), n))


def test_odd_tables_and_the_drawn_rows(spark):
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    assert R.resample(odd.none(spark), target).count() == 0
    assert R.resample(odd.docs(spark), target.limit(0)).count() == len(odd.rows())
    kept = R.drawn(odd.docs(spark), target, least_words=2, percent=50)
    assert kept.columns == odd.docs(spark).columns
    taken = [r for r in R.resample(odd.docs(spark), target, least_words=2, percent=50).collect() if r["rank"]]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in taken} and kept.count() >= len(taken) > 0
