import corpus_pipeline as P
import odd
from granary.llm import common

SF = "/root/testdata/sf0.001"


def test_whole_pipeline(spark):
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5 and P.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in P.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    out = P.STAGES[-1][1](spark, docs, SF)
    assert out.count() == sizes[-1] and sizes[0] > sizes[1] > sizes[2] > sizes[3]
    assert out.selectExpr("sum(n_tokens) = max(start + n_tokens)").first()[0]


def test_stages_reread_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = lambda: sorted(r.doc_id for r in P.drop_near_duplicates(spark, P.accept_quality(spark, docs, SF), SF).collect())
    assert kept() == kept()


def test_stages_take_odd_documents(spark):
    for make in (odd.docs, odd.none):
        docs = make(spark)
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            assert stage(spark, docs, SF).count() <= 2 * docs.count()
        assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()
