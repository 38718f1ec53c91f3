"""Vector search, BM25, fusion, reranking, MMR, whole runs and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import sql as S
from granary.functions import text as T, vectors as V
from granary.operators import nearest as N, postings as X, retrieval as R
from granary.plans import cache as K, config as C, context as P, pipeline
from granary.registry import query
from granary.session import bounded_broadcast, table
from granary.sources import adapters as A, files

RANKED = "query_id, chunk_id, pos, score, rank"


def _sql(ctes: str, last: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} SELECT {RANKED} FROM {last}"


# --- vectors -------------------------------------------------------------------------------------------------------
_PAIRS = f"FROM {S.QUESTION_VECTORS} q, (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings) e"


def _pairs(spark, sf_dir, kind):
    """The score of every question's vector with every vector; the size of this output is the product of both tables' by its nature."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("pos"), "embedding")
    return N.nearest(A.question_vectors(spark, sf_dir), vectors, None, kind).select("query_id", "chunk_id", "score")


@query("vec_cosine", f"SELECT query_id, chunk_id, round(list_cosine_similarity(qv, v), 6) AS score {_PAIRS}")
def vec_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir, "cosine")


@query("vec_dot", f"SELECT query_id, chunk_id, round(list_dot_product(qv, v), 6) AS score {_PAIRS}")
def vec_dot(spark, sf_dir):
    return _pairs(spark, sf_dir, "dot")


@query("vec_l2", f"SELECT query_id, chunk_id, round(list_distance(qv, v), 6) AS score {_PAIRS}")
def vec_l2(spark, sf_dir):
    return _pairs(spark, sf_dir, "l2").withColumn("score", -F.col("score"))


def _vector(spark, sf_dir, **how):
    return R.vector_search(A.question_vectors(spark, sf_dir), A.chunks(spark, sf_dir, embedded=True), how.pop("k", 10), **how).select("query_id", "chunk_id", "pos", "score", "rank")


@query("vector_topk_cosine", _sql(S.vector_ctes(10), "vec"))
def vector_topk_cosine(spark, sf_dir):
    return _vector(spark, sf_dir)


@query("vector_topk_dot", _sql(S.vector_ctes(10, "dot"), "vec"))
def vector_topk_dot(spark, sf_dir):
    return _vector(spark, sf_dir, similarity="dot")


@query("vector_topk_l2", _sql(S.vector_ctes(10, "l2", "true"), "vec"))
def vector_topk_l2(spark, sf_dir):
    return _vector(spark, sf_dir, similarity="l2")


@query("vector_threshold", _sql(S.vector_ctes(1000000, "cosine", "score >= 0.2"), "vec"))
def vector_threshold(spark, sf_dir):
    return _vector(spark, sf_dir, k=None, threshold=0.2)


@query("vec_skip_null", f"SELECT chunk_id FROM {S.CHUNKS} WHERE embedding IS NOT NULL AND len(embedding) > 0")
def vec_skip_null(spark, sf_dir):
    return A.chunks(spark, sf_dir, embedded=True).where(V.usable(F.col("embedding"))).select("chunk_id")


@query("memory_recall", f"WITH {S.vector_ctes(3, 'cosine', 'score >= 0.2')} SELECT query_id, chunk_id, round(score, 3) AS similarity, rank FROM vec")
def memory_recall(spark, sf_dir):
    """The nearest remembered rows above a hard threshold, similarity at three places."""
    return _vector(spark, sf_dir, k=3, threshold=0.2).select("query_id", "chunk_id", F.round("score", 3).alias("similarity"), "rank")


@query("kb_vector_search", _sql(S.vector_ctes(10, extra="AND kb = 'src1'"), "vec"))
def kb_vector_search(spark, sf_dir):
    scoped = A.chunks(spark, sf_dir, embedded=True).where(F.col("kb") == "src1")
    return R.vector_search(A.question_vectors(spark, sf_dir), scoped, max(1, min(10, 100)))


# --- BM25 ----------------------------------------------------------------------------------------------------------
@query("bm25_topk", _sql(S.bm25_ctes(10), "bm"))
def bm25_topk(spark, sf_dir):
    return R.bm25_search(A.questions(spark, sf_dir), A.chunks(spark, sf_dir), 10)


@query("bm25_indexed_topk", _sql(S.bm25_ctes(10), "bm"))
def bm25_indexed_topk(spark, sf_dir):
    """From a written inverted index, of which only the blocks that can hold a question's best are scored."""
    return R.bm25_indexed(A.questions(spark, sf_dir), X.build(A.chunks(spark, sf_dir)), 10)


@query("bm25_keyword_boost", _sql(S.bm25_ctes(10, keywords=True), "bm"))
def bm25_keyword_boost(spark, sf_dir):
    return R.bm25_search(A.questions(spark, sf_dir), A.chunks(spark, sf_dir, keywords=True), 10)


@query("bm25_qtf", _sql(S.bm25_ctes(10, query_sql="SELECT item_id AS query_id, text || ' ' || text || ' ' || text AS query FROM benchmark"), "bm"))
def bm25_qtf(spark, sf_dir):
    q = A.questions(spark, sf_dir).withColumn("query", F.concat_ws(" ", "query", "query", "query"))
    return R.bm25_search(q, A.chunks(spark, sf_dir), 10)


@query("bm25_corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len({S.tok('text')})), 6) AS avgdl FROM documents")
def bm25_corpus_stats(spark, sf_dir):
    return R.corpus_stats(R.indexed_tokens(A.chunks(spark, sf_dir))).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("term_df", f"SELECT tok, count(*) AS df FROM (SELECT unnest(list_distinct({S.tok('text')})) AS tok FROM documents) GROUP BY tok")
def term_df(spark, sf_dir):
    return R.document_frequencies(R.indexed_tokens(A.chunks(spark, sf_dir)))


@query("term_tf", f"SELECT chunk_id, tok, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest({S.tok('text')}) AS tok FROM documents) GROUP BY ALL")
def term_tf(spark, sf_dir):
    return R.term_frequencies(R.indexed_tokens(A.chunks(spark, sf_dir))).select("chunk_id", "tok", "tf")


@query("query_terms", f"SELECT item_id AS query_id, array_to_string({S.terms('text')}, ' ') AS terms FROM benchmark")
def query_terms(spark, sf_dir):
    return A.questions(spark, sf_dir).select("query_id", F.array_join(T.query_terms(F.col("query")), " ").alias("terms"))


@query(
    "matched_keywords",
    f"""WITH q AS (SELECT item_id AS query_id, {S.terms('text')} AS t FROM benchmark), c AS (SELECT doc_id AS chunk_id, {S.longest('text')} AS kw FROM documents)
SELECT query_id, chunk_id, array_to_string(m, ' ') AS matched FROM (SELECT query_id, chunk_id, list_filter(kw, lambda k: len(list_intersect({S.tok('k')}, t)) > 0) AS m FROM q, c) WHERE len(m) > 0""",
)
def matched_keywords(spark, sf_dir):
    """Keywords of a chunk that meet a question, in their order; found by way of the keywords' own tokens."""
    kw = A.chunks(spark, sf_dir, keywords=True).select("chunk_id", F.posexplode("keywords").alias("i", "kw"))
    asked = A.questions(spark, sf_dir).select("query_id", F.explode(F.array_distinct(T.query_terms(F.col("query")))).alias("tok"))
    met = kw.withColumn("tok", F.explode(T.tokens(F.col("kw")))).join(bounded_broadcast(asked), "tok").select("query_id", "chunk_id", "i", "kw").distinct()
    listed = met.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("i", "kw"))).alias("m"))
    return listed.select("query_id", "chunk_id", F.array_join(F.transform("m", lambda s: s["kw"]), " ").alias("matched"))


# --- fusion, reranking, MMR ----------------------------------------------------------------------------------------
def _both(spark, sf_dir, k=20):
    return _vector(spark, sf_dir, k=k), R.bm25_search(A.questions(spark, sf_dir), A.chunks(spark, sf_dir), k)


_BOTH = f"{S.vector_ctes(20)}, {S.bm25_ctes(20)}"


@query("rrf_fusion", _sql(f"{_BOTH}, {S.rrf_cte('vec', 'bm')}", "rrf"))
def rrf_fusion(spark, sf_dir):
    return R.rrf_fusion(*_both(spark, sf_dir))


@query("rrf_weighted", _sql(f"{_BOTH}, {S.rrf_cte('vec', 'bm', vw=0.3, bw=1.7)}", "rrf"))
def rrf_weighted(spark, sf_dir):
    return R.rrf_fusion(*_both(spark, sf_dir), vector_weight=0.3, keyword_weight=1.7)


@query("hybrid_interleave", _sql(f"{_BOTH}, {S.interleave_cte('vec', 'bm', 10)}", "mix"))
def hybrid_interleave(spark, sf_dir):
    return R.interleave(*_both(spark, sf_dir), 10)


@query("rerank_topn", _sql(f"{S.bm25_ctes(20)}, {S.rerank_cte('bm', 20, 10)}", "rer"))
def rerank_topn(spark, sf_dir):
    q, c = A.questions(spark, sf_dir), A.chunks(spark, sf_dir)
    return R.rerank(R.bm25_search(q, c, 20), q, c, 20, 10)


@query("minmax_norm", f"WITH {S.bm25_ctes(15)} SELECT query_id, chunk_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 6) AS relevance FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM bm WINDOW w AS (PARTITION BY query_id))")
def minmax_norm(spark, sf_dir):
    return R.minmax(bm25_topk_n(spark, sf_dir, 15)).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


def bm25_topk_n(spark, sf_dir, k):
    return R.bm25_search(A.questions(spark, sf_dir), A.chunks(spark, sf_dir), k)


_MMR = f"{S.vector_ctes(15)}, {S.mmr_ctes('vec', 15, 8)}"


@query("mmr_select", _sql(_MMR, "mmr WHERE selected", True))
def mmr_select(spark, sf_dir):
    c = A.chunks(spark, sf_dir, embedded=True)
    return R.mmr(_vector(spark, sf_dir, k=15), c).where("selected").select("query_id", "chunk_id", "pos", "score", "rank")


@query("mmr_rejected", f"WITH RECURSIVE {_MMR} SELECT query_id, chunk_id, score, rank, relevance FROM mmr WHERE NOT selected")
def mmr_rejected(spark, sf_dir):
    c = A.chunks(spark, sf_dir, embedded=True)
    return R.mmr(_vector(spark, sf_dir, k=15), c).where("NOT selected").select("query_id", "chunk_id", "score", "rank", "relevance")


@query("strategy_matrix", "SELECT event_id, strategy, vector, bm25, rrf, rerank, mmr FROM events JOIN (VALUES " + ", ".join(f"({i}, '{s}', " + ", ".join(str(C.default_config(s).runs(x)).lower() for x in C.STAGES) + ")" for i, s in enumerate(C.STRATEGIES)) + ") t(i, strategy, vector, bm25, rrf, rerank, mmr) ON i = event_id % 6")
def strategy_matrix(spark, sf_dir):
    """Which stages run for each request, by its strategy."""
    rows = [(i, s, *(C.default_config(s).runs(x) for x in C.STAGES)) for i, s in enumerate(C.STRATEGIES)]
    known = spark.createDataFrame(rows, "no int, strategy string, vector boolean, bm25 boolean, rrf boolean, rerank boolean, mmr boolean")  # a stated list
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(rows)).cast("int").alias("no")).join(F.broadcast(known), "no").drop("no")


# --- whole runs ----------------------------------------------------------------------------------------------------
def _run(strategy):
    def run(spark, sf_dir):
        return pipeline.retrieve(A.questions(spark, sf_dir), A.question_vectors(spark, sf_dir), A.chunks(spark, sf_dir, embedded=True), C.default_config(strategy), A.chunks(spark, sf_dir))

    run.__doc__ = f"The whole run of strategy {strategy} for all questions."
    return run


def _context(*stages: str) -> str:
    union = " UNION ALL ".join(f"SELECT {RANKED}, {i} AS p FROM {s}" for i, s in enumerate(stages))
    return f"SELECT {RANKED} FROM ({union}) QUALIFY p = min(p) OVER (PARTITION BY query_id)"


_WIDE = f"{S.vector_ctes(20)}, {S.bm25_ctes(20)}, {S.rrf_cte('vec', 'bm')}, rrf5 AS (SELECT * FROM rrf WHERE rank <= 5)"
query("pipeline_vector", _sql(S.vector_ctes(5), "vec"))(_run("vector"))
query("pipeline_bm25", _sql(S.bm25_ctes(5), "bm"))(_run("bm25"))
query("pipeline_hybrid", f"WITH {S.vector_ctes(5)}, {S.bm25_ctes(5)}, {S.interleave_cte('vec', 'bm', 5)} {_context('mix', 'vec', 'bm')}")(_run("hybrid"))
query("pipeline_hybrid_rrf", f"WITH {_WIDE} {_context('rrf5', 'vec', 'bm')}")(_run("hybrid-rrf"))
query("pipeline_hybrid_rerank", f"WITH {_WIDE}, {S.rerank_cte('rrf', 20, 5)} {_context('rer', 'rrf5', 'vec', 'bm')}")(_run("hybrid-rerank"))
query("pipeline_hybrid_rerank_mmr", f"WITH RECURSIVE {_WIDE}, {S.rerank_cte('rrf', 20, 15)}, {S.mmr_ctes('rer', 15, 5)}, sel AS (SELECT * FROM mmr WHERE selected) {_context('sel', 'rer', 'rrf5', 'vec', 'bm')}")(_run("hybrid-rerank-mmr"))


@query("final_context", f"WITH {S.vector_ctes(5, 'cosine', 'score >= 0.25')}, {S.bm25_ctes(5)} {_context('vec', 'bm')}")
def final_context(spark, sf_dir):
    v = _vector(spark, sf_dir, k=5, threshold=0.25)
    return R.final_context([(5, v), (6, bm25_topk_n(spark, sf_dir, 5))]).select("query_id", "chunk_id", "pos", "score", "rank")


def _rewritten(spark, sf_dir):
    return A.questions(spark, sf_dir).withColumn("query", F.concat_ws(" ", "query", F.lit("deprecated changelog"), F.lit("v2")))


@query("query_rewrite", _sql(S.bm25_ctes(5, query_sql="SELECT item_id AS query_id, text || ' deprecated changelog v2' AS query FROM benchmark"), "bm"))
def query_rewrite(spark, sf_dir):
    """A question about a feature as a question about its deprecation."""
    return R.bm25_search(_rewritten(spark, sf_dir), A.chunks(spark, sf_dir), 5)


@query("context_union_all", f"WITH {S.vector_ctes(5)}, {S.bm25_ctes(5)} SELECT query_id, chunk_id, 1 AS part, rank FROM vec UNION ALL SELECT query_id, chunk_id, 2, rank FROM bm")
def context_union_all(spark, sf_dir):
    """Two retrievals one after the other, repeats kept."""
    v, b = _both(spark, sf_dir, 5)
    side = lambda df, n: df.select("query_id", "chunk_id", F.lit(n).alias("part"), "rank")
    return side(v, 1).unionByName(side(b, 2))


_REWRITTEN = "SELECT item_id AS query_id, text || ' deprecated changelog v2' AS query FROM benchmark"


@query("fixed_workflow", f"SELECT query_id, chunk_id, 1 AS part, rank FROM (WITH {S.bm25_ctes(5)} SELECT * FROM bm) UNION ALL SELECT query_id, chunk_id, 2, rank FROM (WITH {S.bm25_ctes(5, query_sql=_REWRITTEN)} SELECT * FROM bm)")
def fixed_workflow(spark, sf_dir):
    """The whole fixed workflow: the context of the question, and after it that of the question about deprecation, repeats kept."""
    c, config = A.chunks(spark, sf_dir), C.default_config("bm25", 5).bm25
    counts = X.counts_of(c, config.tokenizer)  # both sets of questions are answered from one reading of the corpus
    own = R.bm25_search(A.questions(spark, sf_dir), c, config.top_k, config.tokenizer, counts)
    return P.fixed_workflow(own, R.bm25_search(_rewritten(spark, sf_dir), c, config.top_k, config.tokenizer, counts))


@query("cache_key", "SELECT item_id AS query_id, sha256(text || '|hybrid|src1') AS cache_key FROM benchmark")
def cache_key(spark, sf_dir):
    return A.questions(spark, sf_dir).select("query_id", F.sha2(F.concat_ws("|", "query", F.lit("hybrid"), F.lit("src1")), 256).alias("cache_key"))


@query("cached_retrieval", _sql(S.bm25_ctes(5), "bm"))
def cached_retrieval(spark, sf_dir):
    """All questions answered through the cache, which half of them have filled before; the rest alone is computed."""
    q, c = A.questions(spark, sf_dir), A.chunks(spark, sf_dir)
    path, version = files.shared_path(spark, "cache"), K.corpus_version(c.select("chunk_id", "content"))
    run = lambda misses: R.bm25_search(misses, c, 5)
    K.cached(q.where(F.col("query_id") % 2 == 0), run, path, version, "bm25")
    return K.cached(q, run, path, version, "bm25")


# --- prompts -------------------------------------------------------------------------------------------------------
@query("relevance_bucket", f"WITH {S.bm25_ctes(10)} SELECT query_id, chunk_id, rank, CASE WHEN n <= 1 OR (rank - 1) / n < 1.0::DOUBLE / 3 THEN 'high' WHEN (rank - 1) / n < 2.0::DOUBLE / 3 THEN 'medium' ELSE 'low' END AS relevance_bucket FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM bm)")
def relevance_bucket(spark, sf_dir):
    return P.relevance_bucket(bm25_topk(spark, sf_dir)).select("query_id", "chunk_id", "rank", "relevance_bucket")


_PROMPT = f"""WITH {S.bm25_ctes(5)},
b AS (SELECT bm.query_id, rank, count(*) OVER (PARTITION BY bm.query_id) AS n, doc_id, text, lang FROM bm JOIN documents ON doc_id = chunk_id),
c AS (SELECT query_id, string_agg('<source id="' || rank || '">' || chr(10) || '  <document>' || chr(10) || '    doc' || doc_id || '.md' || chr(10) || '  </document>' || chr(10) || '  <page>' || (doc_id % 10 + 1) || '</page>'
  || chr(10) || '  <section>' || lang || '</section>' || chr(10) || '  <relevance>' || CASE WHEN n <= 1 OR (rank - 1) / n < 1.0::DOUBLE / 3 THEN 'high' WHEN (rank - 1) / n < 2.0::DOUBLE / 3 THEN 'medium' ELSE 'low' END
  || '</relevance>' || chr(10) || chr(10) || '  <content>' || chr(10) || '    ' || text || chr(10) || '  </content>' || chr(10) || '</source>', chr(10) || chr(10) ORDER BY rank) AS body FROM b GROUP BY query_id),
r AS (SELECT item_id AS query_id, text AS query, {S.estimate('text')} AS user_tokens, CASE WHEN body IS NULL THEN '<retrieved_context></retrieved_context>'
  ELSE '<retrieved_context>' || chr(10) || chr(10) || body || chr(10) || chr(10) || '</retrieved_context>' END AS raw FROM benchmark LEFT JOIN c ON query_id = item_id),
t AS (SELECT query_id, user_tokens, CASE WHEN {S.estimate('raw')} <= greatest(500, 4000 - user_tokens) THEN raw ELSE
  array_to_string(list_slice({S.words('raw')}, 1, CAST(floor(greatest(500, 4000 - user_tokens) * 0.75::DOUBLE) AS BIGINT)), ' ') || chr(10) || chr(10) || '[Context truncated due to token limit]' END AS context FROM r)"""


def _prompt(spark, sf_dir):
    q, c = A.questions(spark, sf_dir), A.chunks(spark, sf_dir)
    return P.build_prompt(q, R.bm25_search(q, c, 5), c)


@query("prompt_context", f"{_PROMPT} SELECT query_id, context FROM t")
def prompt_context(spark, sf_dir):
    return _prompt(spark, sf_dir).select("query_id", "context")


@query("prompt_tokens", f"{_PROMPT} SELECT query_id, 0::BIGINT AS system_tokens, user_tokens, {S.estimate('context')} AS context_tokens, user_tokens + {S.estimate('context')} AS total_tokens FROM t")
def prompt_tokens(spark, sf_dir):
    return _prompt(spark, sf_dir).drop("context")


@query("context_struct", f"WITH {S.bm25_ctes(5)} SELECT query_id, count(*) AS chunk_count, string_agg(chunk_id || ':' || rank || ':0.0:final', ',' ORDER BY rank) AS context FROM bm GROUP BY query_id")
def context_struct(spark, sf_dir):
    """A question's context as an ordered array of structs, here written out."""
    rows = bm25_topk_n(spark, sf_dir, 5).select("query_id", F.struct("rank", "chunk_id", F.lit(0.0).alias("score"), F.lit("final").alias("method")).alias("s"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["chunk_id"], s["rank"], s["score"], s["method"])), ",")
    return listed.select("query_id", F.size("s").cast("long").alias("chunk_count"), text.alias("context"))


@query("context_stats", f"WITH {S.bm25_ctes(5)} SELECT query_id, count(*) AS chunk_count, count(DISTINCT doc_id) AS document_count, CAST(sum({S.estimate('text')}) AS BIGINT) AS token_count FROM bm JOIN documents ON doc_id = chunk_id GROUP BY query_id")
def context_stats(spark, sf_dir):
    c = A.chunks(spark, sf_dir)
    rows = R.bm25_search(A.questions(spark, sf_dir), c, 5).join(c.select("chunk_id", "document_id", T.token_estimate(F.col("content")).alias("n")), "chunk_id")
    return rows.groupBy("query_id").agg(F.count("*").alias("chunk_count"), F.countDistinct("document_id").alias("document_count"), F.sum("n").alias("token_count"))
