"""Whole runs read the corpus once for each stage that needs it, however many later stages read that one's ranks."""

from granary.operators import retrieval as R
from granary.plans import config as C, pipeline


def test_ranks_are_made_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    texts = spark.createDataFrame([(i, i, f"alpha beta w{i}") for i in range(40)], "chunk_id long, pos long, content string").mapInArrow(seen, "chunk_id long, pos long, content string")
    vectors = spark.createDataFrame([(i, [1.0, i / 40]) for i in range(40)], "chunk_id long, embedding array<double>")
    questions = spark.createDataFrame([(1, "alpha w3"), (2, "beta w7")], "query_id long, query string")
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, embedding array<double>")
    chunks = texts.join(vectors, "chunk_id", "left")
    rows = pipeline.retrieve(questions, asked, chunks, C.default_config("hybrid-rerank"), texts).collect()
    assert {r.query_id for r in rows} == {1, 2} and {r.chunk_id for r in rows if r.rank == 1} == {3, 7}
    assert read.value == 3 * 40  # by the vectors' join, the terms' counts and the reranker's texts
