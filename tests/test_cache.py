"""Results that are kept, and files that are replaced in one step."""

import threading

from pyspark.sql import functions as F

from granary.operators import retrieval as R
from granary.plans import cache as K
from granary.sources import files


def tables(spark):
    c = spark.createDataFrame([(i, i, f"word{i % 7} common text {i}") for i in range(40)], "chunk_id long, pos long, content string")
    q = spark.createDataFrame([(i, f"word{i % 9} text") for i in range(12)] + [(50, "word1 text"), (51, "unheard"), (52, None)], "query_id long, query string")
    return c, q


def test_cached_run_equals_the_other_and_computes_misses_alone(spark, tmp_path):
    c, q = tables(spark)
    path, version, asked = str(tmp_path / "cache"), K.corpus_version(c), []

    def run(misses):
        asked.append(sorted(r.query for r in misses.collect()))
        return R.bm25_search(misses, c, 3)

    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(R.bm25_search(q, c, 3).select("query_id", "chunk_id", "pos", "score", "rank"))
    some = q.where("query_id < 4 OR query_id = 51")
    assert rows(K.cached(some, run, path, version, "bm25")) == [r for r in want if r[0] < 4 or r[0] == 51]
    assert rows(K.cached(q, run, path, version, "bm25")) == want and rows(K.cached(q, run, path, version, "bm25")) == want
    assert asked == [sorted([*(f"word{i} text" for i in range(4)), "unheard"]), sorted(["", *(f"word{i} text" for i in range(4, 9))])]
    assert rows(K.cached(q.limit(0), run, path, version, "bm25")) == [] and len(asked) == 2
    more = c.union(spark.createDataFrame([(99, 99, "word3 text")], c.schema))
    assert K.corpus_version(more) != version == K.corpus_version(c.orderBy(F.desc("chunk_id")).repartition(3))
    K.cached(q, run, path, K.corpus_version(more), "bm25")
    assert len(asked) == 3 and [p.name for p in (tmp_path / "cache").iterdir()] == [f"version={K.corpus_version(more)}"]


def test_keys_tell_questions_strategies_and_bases_apart(spark):
    df = spark.range(1).select(*(K.cache_key(F.lit(q), s, k).alias(str(i)) for i, (q, s, k) in enumerate([("a", "x", None), ("a", "y", None), ("b", "x", None), ("a", "x", "k"), ("a", "x", "")])))
    r = df.first()
    assert len({r[0], r[1], r[2], r[3]}) == 4 and r[0] == r[4]


def test_readers_never_miss_a_file_that_is_replaced(spark, tmp_path):
    at = tmp_path / "pointer.json"
    files.put_atomic(spark, f"file://{at}", "0")
    seen, stop = set(), threading.Event()

    def read():
        while not stop.is_set():
            seen.add(at.read_text())

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(200):
        files.put_atomic(spark, str(at), f"text {i}" * 100)
    stop.set()
    reader.join()
    assert "" not in seen and all(s == "0" or s == s[: len(s) // 100] * 100 for s in seen)
    assert spark.read.text(f"file://{at}").first()[0] == "text 199" * 100 and [p.name for p in tmp_path.iterdir()] == ["pointer.json"]
