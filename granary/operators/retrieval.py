"""Ranked retrieval for many questions at once: exact nearest neighbours, BM25, fusion, reranking and MMR.

Every ranked result carries query_id, chunk_id, score, rank and pos; pos breaks ties, so results don't depend on the
order of rows. Scores are rounded to six places before they are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions import text as T, vectors as V
from granary.operators import nearest as N, postings as P
from granary.operators.postings import indexed_tokens  # noqa: F401
from granary.session import bounded_broadcast
from granary.sources.tables import written

#: Further similarities by name: scores of (query vector, chunk vector, their norms); greater is nearer.
SIMILARITIES: dict = {}


def ranked(scored: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """Adds rank within query_id by the given order, or by score and pos, and keeps the first k; the cut goes below the shuffle."""
    by = order or (F.desc("score"), F.asc("pos"))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int, similarity: str = "cosine", threshold: float = 0.0) -> DataFrame:
    """Exact nearest chunks of queries(query_id, embedding) among chunks(chunk_id, pos, embedding).

    'cosine', 'dot' and 'l2' are blocked matrix products. Chunks without a vector are left out; scores below the threshold too, except that a distance (negated as the
    score) is only cut at a threshold other than 0, and then keeps scores at or below it.
    """
    if similarity in N.KINDS:
        least = None if similarity == "l2" and not threshold else threshold
        return ranked(N.nearest(queries, chunks, k, similarity, least), k)
    if similarity not in SIMILARITIES:
        raise ValueError(f"unknown similarity {similarity!r}; known: {', '.join([*N.KINDS, *SIMILARITIES])}")
    # a registered expression has no matrix form and no bounds: it is computed pair by pair
    q = bounded_broadcast(queries.select("query_id", F.col("embedding").alias("qv")).where(V.usable(F.col("qv"))).withColumn("qn", V.norm(F.col("qv"))))
    c = chunks.select("chunk_id", "pos", F.col("embedding").alias("cv")).where(V.usable(F.col("cv"))).withColumn("cn", V.norm(F.col("cv")))
    score = SIMILARITIES[similarity](F.col("qv"), F.col("cv"), F.col("qn"), F.col("cn"))
    return ranked(c.crossJoin(q).select("query_id", "chunk_id", "pos", F.round(score, 6).alias("score")).where(F.col("score") >= threshold), k)


def corpus_stats(indexed: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl, empty documents included."""
    return indexed.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl"))


def term_frequencies(indexed: DataFrame) -> DataFrame:
    """chunk_id, pos, dl, tok, tf."""
    return P.counted(indexed).where("tok IS NOT NULL")


def document_frequencies(indexed: DataFrame) -> DataFrame:
    """tok, df; each document's distinct tokens go through the shuffle once."""
    return indexed.select(F.explode(F.array_distinct("tokens")).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int | None, kind: str = "standard", counts: DataFrame | None = None) -> DataFrame:
    """BM25 of queries(query_id, query) over chunks(chunk_id, pos, content[, keywords]); a term that a query repeats counts as often.

    The corpus is read and cut into tokens once; asked tokens are counted where the documents are, into a written table.
    Several sets of questions share that reading by counts, which postings.counts_of(chunks, kind) gives, or by an index.
    """
    return ranked(P.scores(queries, chunks, kind, counts), k)


def bm25_indexed(queries: DataFrame, index: P.Index, k: int) -> DataFrame:
    """bm25_search() from a written index, of which only the blocks that can hold a question's k best are scored."""
    return P.search(index, queries, k)


def rrf_fusion(vector: DataFrame, keyword: DataFrame, k: int = 60, vector_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """Weighted reciprocal ranks summed over both lists; ties go to the vector list's order, then to the other's."""
    side = lambda df, w, n: df.select("query_id", "chunk_id", "pos", (F.lit(w) / (k + F.col("rank"))).alias("part"), F.when(F.lit(n == 0), F.col("rank")).alias("vr"), F.when(F.lit(n == 1), F.col("rank")).alias("br"))
    both = side(vector, float(vector_weight), 0).unionByName(side(keyword, float(keyword_weight), 1))
    fused = both.groupBy("query_id", "chunk_id", "pos").agg(F.round(F.sum("part"), 9).alias("score"), F.max("vr").alias("vr"), F.max("br").alias("br"))
    return ranked(fused, None, F.desc("score"), F.coalesce("vr", F.lit(10**9)), F.col("br")).drop("vr", "br")


def interleave(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """vector 1, keyword 1, vector 2, ...: the first place of every chunk, the first k of these."""
    both = vector.select("query_id", "chunk_id", "pos", "score", (F.col("rank") * 2).alias("place")).unionByName(keyword.select("query_id", "chunk_id", "pos", "score", (F.col("rank") * 2 + 1).alias("place")))
    first = both.groupBy("query_id", "chunk_id", "pos").agg(F.min_by("score", "place").alias("score"), F.min("place").alias("place"))
    return ranked(first, k, F.asc("place")).drop("place")


def coverage(query: Column, content: Column) -> Column:
    """Share of the query's distinct terms among the content's tokens: the scorer that needs no model."""
    terms = F.array_distinct(T.query_terms(query))
    return F.round(F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(terms, T.tokens(content))) / F.size(terms)), 9)


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, candidate_count: int = 20, top_n: int = 10, scorer=coverage) -> DataFrame:
    """The first candidate_count of candidates in the order of a scorer(query, content) column; earlier ranks win ties."""
    cut = written(candidates.where(F.col("rank") <= candidate_count).select("query_id", "chunk_id", "pos", F.col("rank").alias("before")), "candidates")
    asked = bounded_broadcast(cut.join(bounded_broadcast(queries.select("query_id", "query")), "query_id"))  # so that the texts stay where they are
    texts = asked.join(chunks.select("chunk_id", "content"), "chunk_id")
    return ranked(texts.select("query_id", "chunk_id", "pos", "before", scorer(F.col("query"), F.col("content")).alias("score")), top_n, F.desc("score"), F.asc("before")).drop("before")


def minmax(candidates: DataFrame) -> DataFrame:
    """Adds relevance: the score between the least and the greatest of the question, 0 if they are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return candidates.withColumn("relevance", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(0.0)))


def mmr(candidates: DataFrame, chunks: DataFrame, weight: float = 0.7, candidate_count: int = 15, final_count: int = 8) -> DataFrame:
    """Maximal marginal relevance over the first candidate_count of each question: all of them, selected or not.

    A fold over at most final_count steps per question; its state is the chosen indices and their values. A question's
    candidates are at most candidate_count, so their array and its similarities are small by construction. Vectors
    that are missing have similarity 0; the earliest candidate wins ties; the rejected are valued against all chosen.
    """
    vectors = chunks.select("chunk_id", F.col("embedding").alias("v"))
    cut = minmax(candidates.where(F.col("rank") <= candidate_count)).select("query_id", "chunk_id", "pos", "rank", F.col("relevance").alias("rel"))
    rows = cut.join(vectors, "chunk_id", "left").withColumn("n", V.norm(F.col("v")))
    c = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "pos", "rel", "v", "n"))).alias("c"))
    sims = F.transform("c", lambda a: F.transform("c", lambda b: F.coalesce(V.cosine(a["v"], b["v"], a["n"], b["n"]), F.lit(0.0))))
    slim = c.withColumn("sim", sims).withColumn("c", F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["pos"].alias("pos"), x["rel"].alias("rel"))))
    slim = slim.withColumn("i", F.sequence(F.lit(0), F.size("c") - 1))

    def closeness(i: Column, chosen: Column) -> Column:
        return F.aggregate(chosen, F.lit(0.0), lambda m, j: F.greatest(m, F.get(F.get("sim", i), j)))

    def value(i: Column, chosen: Column) -> Column:
        return F.round(F.lit(weight) * F.get("c", i)["rel"] - F.lit(1 - weight) * closeness(i, chosen), 6)

    def step(state: Column, _: Column) -> Column:
        left = F.filter("i", lambda i: ~F.array_contains(state["chosen"], i))
        best = F.array_max(F.transform(left, lambda i: F.struct(value(i, state["chosen"]).alias("v"), (-i).alias("j"))))
        return T.let(best, lambda b: F.struct(F.array_append(state["chosen"], -b["j"]).alias("chosen"), F.array_append(state["value"], b["v"]).alias("value")))

    zero = F.struct(F.array().cast("array<int>").alias("chosen"), F.array().cast("array<double>").alias("value"))
    rounds = F.slice(F.col("i"), 1, final_count)
    folded = slim.withColumn("state", F.aggregate(rounds, zero, step))
    rejected = F.transform(F.filter("i", lambda i: ~F.array_contains(F.col("state.chosen"), i)), lambda i: F.struct(i.alias("i"), value(i, F.col("state.chosen")).alias("score"), F.lit(0).alias("rank")))
    chosen = F.transform(F.col("state.chosen"), lambda i, p: F.struct(i.alias("i"), F.get("state.value", p).alias("score"), (p + 1).alias("rank")))
    out = folded.select("query_id", "c", F.explode(F.concat(chosen, rejected)).alias("r"))
    picked = F.get("c", F.col("r.i"))
    return out.select("query_id", picked["chunk_id"].alias("chunk_id"), picked["pos"].alias("pos"), F.col("r.score").alias("score"), F.col("r.rank").cast("long").alias("rank"), (F.col("r.rank") > 0).alias("selected"), F.round(picked["rel"], 6).alias("relevance"))


def final_context(stages: list[tuple[int, DataFrame]]) -> DataFrame:
    """Per question the rows of the first stage that has any; stages come as (priority, ranked rows)."""
    cols = ["query_id", "chunk_id", "pos", "score", "rank"]
    tagged = None
    for priority, df in stages:
        part = df.select(*cols, F.lit(priority).alias("priority"))
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.withColumn("best", F.min("priority").over(Window.partitionBy("query_id")))
    return best.where("priority = best").drop("best")
