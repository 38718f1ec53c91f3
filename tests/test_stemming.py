"""Porter's stems against the examples that were published with the algorithm, and search by them."""

from pyspark.sql import functions as F

from granary.functions import stemming as P, text as T
from granary.operators import retrieval as R

PAIRS = """
caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil as as is is by by
""".split()


def test_published_pairs():
    for word, stem in zip(PAIRS[::2], PAIRS[1::2], strict=True):
        assert P.stem(word) == stem, word


def test_arrays_of_words(spark):
    df = spark.createDataFrame([(1, ["cats", "cats", "running"]), (2, []), (3, None), (4, ["é", "x9", None])], "i int, w array<string>").repartition(2)
    assert {r.i: r.s for r in df.select("i", P.stems(F.col("w")).alias("s")).collect()} == {1: ["cat", "cat", "run"], 2: [], 3: None, 4: ["é", "x9", None]}


def test_search_by_stems(spark):
    c = spark.createDataFrame([(1, 1, "The connections were motoring along"), (2, 2, "a connected motor"), (3, 3, "nothing of it"), (4, 4, None)], "chunk_id int, pos int, content string")
    q = spark.createDataFrame([(1, "connecting motors"), (2, "what is")], "query_id int, query string")
    assert {r.chunk_id for r in R.bm25_search(q, c, 5, "porter").collect() if r.query_id == 1} == {1, 2}
    assert R.bm25_search(q, c, 5, "standard").where("query_id = 1").count() == 0
    assert [r.t for r in c.where("chunk_id = 1").select(T.tokens(F.col("content"), "porter").alias("t")).collect()] == [["the", "connect", "were", "motor", "along"]]
