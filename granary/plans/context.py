"""Prompts from ranked chunks: relevance buckets, source blocks and the token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from granary.functions import text as T

MAX_CHUNKS, MAX_TOKENS, LEAST_TOKENS = 5, 4000, 500


def relevance_bucket(ranked: DataFrame) -> DataFrame:
    """Adds relevance_bucket: thirds of a question's ranks by position, high for a single one."""
    total = F.count("*").over(Window.partitionBy("query_id"))
    place = (F.col("rank") - 1) / total
    return ranked.withColumn("relevance_bucket", F.when(total <= 1, "high").when(place < F.lit(1.0) / 3, "high").when(place < F.lit(2.0) / 3, "medium").otherwise("low"))


def build_prompt(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, system: str = "") -> DataFrame:
    """query_id, context, system_tokens, user_tokens, context_tokens, total_tokens of each question's first MAX_CHUNKS chunks."""
    first = relevance_bucket(ranked.where(F.col("rank") <= MAX_CHUNKS))
    known = chunks.select("chunk_id", "document_name", "page", "section", "content")
    rows = first.join(known, "chunk_id")
    section = F.when(F.col("section").isNotNull() & (F.col("section") != ""), F.concat(F.lit("\n  <section>"), "section", F.lit("</section>"))).otherwise("")
    block = F.concat(
        F.lit('<source id="'), F.col("rank").cast("string"), F.lit('">\n  <document>\n    '), "document_name", F.lit("\n  </document>\n  <page>"), F.col("page").cast("string"), F.lit("</page>"), section,
        F.lit("\n  <relevance>"), "relevance_bucket", F.lit("</relevance>\n\n  <content>\n    "), "content", F.lit("\n  </content>\n</source>"),
    )
    joined = rows.select("query_id", F.struct("rank", block.alias("b")).alias("s")).groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    body = F.array_join(F.transform("s", lambda s: s["b"]), "\n\n")
    out = queries.join(joined, "query_id", "left").withColumn("raw", F.when(F.col("s").isNull(), F.lit("<retrieved_context></retrieved_context>")).otherwise(F.concat(F.lit("<retrieved_context>\n\n"), body, F.lit("\n\n</retrieved_context>"))))
    out = out.withColumns({"system_tokens": T.token_estimate(F.lit(system)), "user_tokens": T.token_estimate(F.col("query"))})
    out = out.withColumn("context", T.truncate_tokens(F.col("raw"), F.greatest(F.lit(LEAST_TOKENS), F.lit(MAX_TOKENS) - F.col("system_tokens") - F.col("user_tokens"))))
    out = out.withColumn("context_tokens", T.token_estimate(F.col("context")))
    return out.select("query_id", "context", "system_tokens", "user_tokens", "context_tokens", (F.col("system_tokens") + F.col("context_tokens") + F.col("user_tokens")).alias("total_tokens"))


def fixed_workflow(own: DataFrame, rewritten: DataFrame) -> DataFrame:
    """query_id, chunk_id, part, rank: the context of each question (1) and of its rewritten form (2), one after the other."""
    side = lambda df, n: df.select("query_id", "chunk_id", F.lit(n).alias("part"), "rank")
    return side(own, 1).unionByName(side(rewritten, 2))
