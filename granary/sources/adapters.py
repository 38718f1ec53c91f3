"""The test tables as the relations that the operators take: chunks, questions, traces, spans, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions import text as T
from granary.session import bounded_broadcast, table, text_table


def chunks(spark: SparkSession, sf_dir: str, embedded: bool = False, keywords: bool = False) -> DataFrame:
    """chunk_id, document_id, document_name, content, page, section, kb, pos, and embedding or keywords if asked for."""
    docs = text_table(spark, sf_dir, "documents")
    out = docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md")).alias("document_name"), F.col("text").alias("content"),
        (F.col("doc_id") % 10 + 1).alias("page"), F.col("lang").alias("section"), F.col("source").alias("kb"), F.col("doc_id").alias("pos"),
    )
    if keywords:
        out = out.withColumn("keywords", T.longest_words(F.col("content")))
    if embedded:
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
        out = out.join(vectors, "chunk_id", "left")
    return out


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, embedding of the questions that have a vector."""
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return table(spark, sf_dir, "embeddings").join(bounded_broadcast(ids), F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")


def expected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, chunk_id: documents that hold a question's text word for word."""
    docs = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return holders(docs, questions(spark, sf_dir))


def holders(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id of docs(chunk_id, text) whose text contains the query of queries(query_id, query).

    A text that contains a query has the query's inner words as words of its own, so documents are looked up by the
    longest of these and verified; queries of fewer than three words, which have none, are searched for one by one.
    """
    words = F.split("query", r"\s+")
    key = F.array_max(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = queries.select("query_id", "query", F.nullif(key, F.lit("")).alias("key"))
    known = bounded_broadcast(keyed.where("key IS NOT NULL"))
    met = docs.select("chunk_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("key")).join(known, "key").select("query_id", "query", F.col("chunk_id").alias("at"))
    found = docs.join(met, F.col("chunk_id") == F.col("at")).where(F.contains(F.col("text"), F.col("query"))).select("query_id", "chunk_id")
    short = docs.join(bounded_broadcast(keyed.where("key IS NULL"), 1000), F.contains(F.col("text"), F.col("query"))).select("query_id", "chunk_id")
    return found.unionByName(short)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, timestamp, session_id, request_id, kind, status, error, prompt_version, total_latency_ms, cost_usd, provider, model, sources."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("session_id"), (F.col("event_id") % 1000).alias("request_id"), F.col("event_type").alias("kind"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.when(F.col("event_type") == "error", F.lit("error")).alias("error"),
        F.concat(F.lit("v"), k % 2).alias("prompt_version"), F.when(F.col("event_id") % 7 != 0, F.col("value") * 10).alias("total_latency_ms"), F.when(F.col("event_id") % 5 != 0, k * F.lit(0.0000005)).alias("cost_usd"),
        F.concat(F.lit("p"), k % 3).alias("provider"), F.concat(F.lit("m"), k % 5).alias("model"), F.array(F.struct(k.alias("chunk_id")), F.struct((k + 1).alias("chunk_id"))).alias("sources"),
    )


#: traces() in DuckDB.
TRACES_SQL = """(SELECT event_id AS id, ts AS "timestamp", user_id AS session_id, event_id % 1000 AS request_id, event_type AS kind,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN event_type = 'error' THEN 'error' END AS error,
  'v' || (k % 2) AS prompt_version, CASE WHEN event_id % 7 <> 0 THEN value * 10 END AS total_latency_ms, CASE WHEN event_id % 5 <> 0 THEN k * 0.0000005::DOUBLE END AS cost_usd,
  'p' || (k % 3) AS provider, 'm' || (k % 5) AS model, [k, k + 1] AS source_ids, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id (user and day), stage, tokens, cost, start_ts, end_ts."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("stage"), k.alias("tokens"),
        (k * F.lit(0.0000004)).alias("cost"), F.col("ts").alias("start_ts"), (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 97).cast("decimal(18,6)"))).alias("end_ts"),
    )


SPANS_SQL = """(SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id AS span_id, event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * 0.0000004::DOUBLE AS cost, ts AS start_ts, ts + to_seconds(event_id % 97) AS end_ts FROM events)"""


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded cases out of labelled documents: ids, grouping keys, metrics (some missing), status and failure categories."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    i = F.col("doc_id")
    return d.select(
        i.alias("case_id"), F.when(F.col("lang") != "de", F.col("lang")).alias("difficulty"), F.array("lang", "source").alias("tags"), F.col("source").alias("problem_type"), F.col("lang").alias("mode"),
        F.when(F.col("quality") == 1, "passed").when(F.col("toxic") == 1, "partial").otherwise("failed").alias("status"),
        F.col("quality").cast("double").alias("hit_rate"), (i % 5 / 5).alias("recall"), (i % 3 / 3).alias("precision"), (F.lit(1.0) / (1 + i % 4)).alias("mrr"), F.when(i % 11 != 0, i % 7 / 7).alias("ndcg"),
        F.col("n_chars").cast("double").alias("latency_ms"), F.when(F.col("quality") == 0, F.array(F.when(F.col("toxic") == 1, "poor_answer").otherwise("poor_ranking"), F.lit("unheard_of"))).otherwise(F.array().cast("array<string>")).alias("failures"),
        (F.col("quality") == 1).alias("outcome_pass"), ((F.col("quality") == 1) & (i % 2 == 0)).alias("trajectory_pass"),
    )


#: case_results() in DuckDB.
CASES_SQL = """(SELECT doc_id AS case_id, CASE WHEN lang <> 'de' THEN lang END AS difficulty, [lang, source] AS tags, source AS problem_type, lang AS mode,
  CASE WHEN quality = 1 THEN 'passed' WHEN toxic = 1 THEN 'partial' ELSE 'failed' END AS status, quality::DOUBLE AS hit_rate, (doc_id % 5)::DOUBLE / 5 AS recall, (doc_id % 3)::DOUBLE / 3 AS "precision",
  1.0::DOUBLE / (1 + doc_id % 4) AS mrr, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 7)::DOUBLE / 7 END AS ndcg, n_chars::DOUBLE AS latency_ms,
  CASE WHEN quality = 0 THEN [CASE WHEN toxic = 1 THEN 'poor_answer' ELSE 'poor_ranking' END, 'unheard_of'] ELSE [] END AS failures,
  quality = 1 AS outcome_pass, quality = 1 AND doc_id % 2 = 0 AS trajectory_pass FROM documents JOIN labels USING (doc_id))"""


def arm_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, case_id, latency_ms, tokens, cost, passed of two arms."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("arm"), F.col("l_partkey").alias("case_id"), F.col("l_extendedprice").alias("latency_ms"), F.col("l_quantity").cast("long").alias("tokens"),
        (F.col("l_quantity") * 0.0000005).alias("cost"), (F.col("l_returnflag") != "R").alias("passed"), F.col("l_orderkey"), F.col("l_linenumber"),
    )


ARMS_SQL = "(SELECT l_linestatus AS arm, l_partkey AS case_id, l_extendedprice AS latency_ms, CAST(l_quantity AS BIGINT) AS tokens, l_quantity * 0.0000005::DOUBLE AS cost, l_returnflag <> 'R' AS passed, l_orderkey, l_linenumber FROM lineitem)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, answer, question, keywords: turns as answers to the turn before."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    joined = c.join(before, ["conv_id", "turn"])
    return joined.select(F.concat_ws(":", "conv_id", "turn").alias("case_id"), F.col("text").alias("answer"), "question", F.slice(T.space_words(F.col("question")), 1, 3).alias("keywords"))


ANSWERS_SQL = """(SELECT c.conv_id || ':' || c.turn AS case_id, c.text AS answer, b.text AS question, list_slice(list_filter(regexp_split_to_array(b.text, '\\s+'), lambda w: w <> ''), 1, 3) AS keywords
  FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1)"""
