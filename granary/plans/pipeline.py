"""Whole retrieval runs for many questions, built of the stages that the strategy has. What a stage ranks is written, as
several later ones read it: some rows for each question, whose making reads the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from granary.operators import retrieval as R
from granary.plans.config import RetrievalConfig
from granary.sources.tables import written


def retrieve(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, config: RetrievalConfig, texts: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, pos, score, rank of the final context.

    queries(query_id, query), vectors(query_id, embedding), chunks(chunk_id, pos, content, embedding). A question
    without a vector degrades to what the other stages find; the last stage that has rows for it decides. texts are
    the chunks without their vectors, where these come from another table: so no text goes through the join with it.
    """
    texts = chunks.drop("embedding") if texts is None else texts
    stages: list[tuple[int, DataFrame]] = []
    vector = keyword = fused = reranked = None
    if config.runs("vector"):
        vector = written(R.vector_search(vectors, chunks, config.vector.top_k, config.vector.similarity, config.vector.similarity_threshold), "vector")
        stages.append((5, vector))
    if config.runs("bm25"):
        keyword = written(R.bm25_search(queries, texts, config.bm25.top_k, config.bm25.tokenizer), "keyword")
        stages.append((6, keyword))
    if vector is not None and keyword is not None:
        if config.runs("rrf"):
            fused = written(R.rrf_fusion(vector, keyword, config.rrf.k, config.rrf.vector_weight, config.rrf.bm25_weight), "fused")
            stages.append((3, fused.where(F.col("rank") <= config.rrf.top_n)))
        else:
            stages.append((4, R.interleave(vector, keyword, config.vector.top_k)))
    if config.runs("rerank") and fused is not None:
        reranked = written(R.rerank(fused, queries, texts, config.reranker.candidate_count, config.reranker.top_n), "reranked")
        stages.append((2, reranked))
    if config.runs("mmr") and reranked is not None:
        chosen = R.mmr(reranked, chunks, config.mmr.lambda_, config.mmr.candidate_count, config.mmr.final_count)
        stages.append((1, chosen.where("selected").drop("selected", "relevance")))
    return R.final_context(stages).drop("priority")
