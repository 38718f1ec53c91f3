"""Metrics, averages, comparisons and agent trajectories."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from granary.catalog import checks, sql as S
from granary.functions import text as T
from granary.operators import evaluation as E, retrieval as R
from granary.registry import query
from granary.session import table
from granary.sources import adapters as A
from granary.sources.adapters import ANSWERS_SQL, ARMS_SQL, CASES_SQL


# --- retrieval metrics ---------------------------------------------------------------------------------------------
def _retrieved(spark, sf_dir):
    c = A.chunks(spark, sf_dir).select("chunk_id", "document_name", "page")
    rows = R.bm25_search(A.questions(spark, sf_dir), A.chunks(spark, sf_dir), 10).join(c, "chunk_id")
    return rows.select("query_id", "rank", "chunk_id", E.source_keys(F.col("chunk_id"), F.col("document_name"), F.col("page")).alias("keys"))


def _expected(spark, sf_dir):
    rows = A.expected_sources(spark, sf_dir)
    no = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")).cast("long")
    return rows.select("query_id", no.alias("exp_no"), E.source_keys(F.col("chunk_id"), F.lit(None).cast("string"), F.lit(None).cast("int")).alias("keys"))


_IR = f"""WITH {S.bm25_ctes(10)}, x AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
n AS (SELECT query_id, count(*) AS n_exp FROM x GROUP BY query_id), m AS (SELECT bm.query_id, rank FROM bm JOIN x ON x.query_id = bm.query_id AND x.chunk_id = bm.chunk_id),
g AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM m GROUP BY query_id), c AS (SELECT query_id, count(*) AS n_ret FROM bm GROUP BY query_id),
r AS (SELECT n.query_id, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, round(coalesce(hits / n_exp, 0), 4) AS recall, round(coalesce(hits / n_ret, 0), 4) AS "precision", round(coalesce(1.0::DOUBLE / first, 0), 4) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n_exp, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0), 4) AS ndcg, n_exp, coalesce(n_ret, 0) AS n_ret FROM n LEFT JOIN c USING (query_id) LEFT JOIN g USING (query_id))"""


def _metrics(spark, sf_dir):
    return E.ir_metrics(_retrieved(spark, sf_dir), _expected(spark, sf_dir))


def _register_metric(name: str, column: str) -> None:
    quoted = f'"{column}"'

    def run(spark, sf_dir):
        return _metrics(spark, sf_dir).select("query_id", column)

    query(name, f"{_IR} SELECT query_id, {quoted} FROM r")(run)


for _name, _column in (("ir_hit_rate", "hit_rate"), ("ir_recall", "recall"), ("ir_precision", "precision"), ("ir_mrr", "mrr"), ("ir_ndcg", "ndcg")):
    _register_metric(_name, _column)


@query("ir_ndcg_multi")
def ir_ndcg_multi(spark, sf_dir):
    """Expected pages that several retrieved chunks are of; compared with a plain model in the tests."""
    r = A.chunks(spark, sf_dir).select("chunk_id", "page")
    ret = R.bm25_search(A.questions(spark, sf_dir), A.chunks(spark, sf_dir), 10).join(r, "chunk_id").select("query_id", "rank", F.array(F.concat(F.lit("doc:x|"), "page")).alias("keys"))
    exp = A.questions(spark, sf_dir).select("query_id", F.posexplode(F.array(F.col("query_id") % 10 + 1, F.col("query_id") % 3 + 1, F.col("query_id") % 10 + 1)).alias("exp_no", "page"))
    return E.ir_metrics(ret, exp.select("query_id", F.col("exp_no").cast("long").alias("exp_no"), F.array(F.concat(F.lit("doc:x|"), "page")).alias("keys"))).select("query_id", "ndcg")


@query("source_match_any", f"WITH {S.bm25_ctes(10)}, x AS (SELECT item_id AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS exp_no FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT bm.query_id, rank, exp_no FROM bm JOIN x ON x.query_id = bm.query_id AND x.chunk_id = bm.chunk_id")
def source_match_any(spark, sf_dir):
    return E.source_matches(_retrieved(spark, sf_dir), _expected(spark, sf_dir))


@query("source_match_stem", "SELECT DISTINCT p.page_id, q.page_id AS other FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS s FROM pages) p JOIN (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS s FROM pages) q ON p.s = q.s AND p.page_id % 3 = q.page_id % 3")
def source_match_stem(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item"), T.document_stem(F.col("url")).alias("s"), (F.col("page_id") % 3).alias("page"))
    return E.pairs_within(p, ["s", "page"]).select(F.col("item").alias("page_id"), "other")


_STATUS = f"""{_IR}, s AS (SELECT b.item_id AS query_id, coalesce(n_exp, 0) AS n_exp, coalesce(n_ret, 0) AS n_ret, hit_rate, recall, CASE WHEN b.item_id % 9 = 0 THEN 'I do not know' ELSE 'fine' END AS answer, CASE WHEN b.item_id % 13 = 5 THEN 'boom' END AS error FROM benchmark b LEFT JOIN r ON r.query_id = b.item_id)
SELECT query_id, CASE WHEN n_exp = 0 THEN 'not_run' WHEN error IS NOT NULL OR hit_rate = 0 OR answer = 'I do not know' THEN 'failed' WHEN recall >= 0.999 THEN 'passed' ELSE 'partial' END AS status,
  CASE WHEN n_exp = 0 THEN NULL WHEN error IS NOT NULL THEN 'llm_failure' WHEN hit_rate = 0 AND n_ret > 0 THEN 'missing_source' WHEN hit_rate = 0 THEN 'retrieval_failure' WHEN answer = 'I do not know' THEN 'prompt_issue' WHEN recall >= 0.999 THEN NULL ELSE 'poor_ranking' END AS failure FROM s"""


@query("case_status", _STATUS)
def case_status(spark, sf_dir):
    q = A.questions(spark, sf_dir).join(_metrics(spark, sf_dir), "query_id", "left").fillna(0, ["n_exp", "n_ret"])
    q = q.withColumns({"answer": F.when(F.col("query_id") % 9 == 0, "I do not know").otherwise("fine"), "error": F.when(F.col("query_id") % 13 == 5, "boom")})
    status, category = E.case_status(*(F.col(c) for c in ("hit_rate", "recall", "n_exp", "n_ret", "answer", "error")))
    return q.select("query_id", status.alias("status"), category.alias("failure"))


@query("case_cost", "SELECT event_id, coalesce(i, p, 0) AS input_tokens, coalesce(o, 0) AS output_tokens, coalesce(i, p, 0) + coalesce(o, 0) AS total_tokens, round((coalesce(i, p, 0) + coalesce(o, 0)) * 0.0005::DOUBLE, 4) AS cost FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN k END AS i, CASE WHEN event_id % 4 <> 0 THEN k * 2 END AS p, CASE WHEN event_id % 5 <> 0 THEN k + 1 END AS o FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))")
def case_cost(spark, sf_dir):
    """Input tokens of the model or else of the prompt, output tokens, and a flat rate's cost at 4 places."""
    k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(i % 3 == 0, k), F.when(i % 4 != 0, k * 2), F.lit(0)).alias("input_tokens"), F.coalesce(F.when(i % 5 != 0, k + 1), F.lit(0)).alias("output_tokens"))
    total = F.col("input_tokens") + F.col("output_tokens")
    return e.select("event_id", "input_tokens", "output_tokens", total.alias("total_tokens"), F.round(total * F.lit(0.0005), 4).alias("cost"))


# --- averages and breakdowns ---------------------------------------------------------------------------------------
_AVG = ", ".join(f'round(coalesce(avg(coalesce("{m}", 0)), 0), 4) AS "{m}"' for m in E.METRICS)


@query("metric_avg", f"SELECT {_AVG} FROM {CASES_SQL}")
def metric_avg(spark, sf_dir):
    return E.average_metrics(A.case_results(spark, sf_dir))


@query("by_difficulty", f"SELECT coalesce(difficulty, 'medium') AS difficulty, {_AVG} FROM {CASES_SQL} GROUP BY 1")
def by_difficulty(spark, sf_dir):
    return E.average_metrics(A.case_results(spark, sf_dir), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"))


@query("by_tag", f"SELECT tag, {_AVG} FROM (SELECT *, unnest(tags) AS tag FROM {CASES_SQL}) GROUP BY tag")
def by_tag(spark, sf_dir):
    return E.average_metrics(A.case_results(spark, sf_dir).withColumn("tag", F.explode("tags")), "tag")


@query("failure_hist", f"SELECT category, coalesce(n, 0) AS n FROM (SELECT unnest([{S.quoted(E.FAILURES)}]) AS category) LEFT JOIN (SELECT category, count(*) AS n FROM (SELECT unnest(failures) AS category FROM {CASES_SQL}) GROUP BY 1) USING (category)")
def failure_hist(spark, sf_dir):
    return E.failure_histogram(A.case_results(spark, sf_dir))


@query("status_counts", f"SELECT count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'passed') / count(*), 4) AS pass_rate FROM {CASES_SQL}")
def status_counts(spark, sf_dir):
    return E.status_counts(A.case_results(spark, sf_dir))


@query("avg_present", f"SELECT problem_type, round(avg(ndcg), 4) AS present, round(avg(coalesce(ndcg, 0)), 4) AS counted FROM {CASES_SQL} GROUP BY 1")
def avg_present(spark, sf_dir):
    return A.case_results(spark, sf_dir).groupBy("problem_type").agg(F.round(F.avg("ndcg"), 4).alias("present"), F.round(F.avg(F.coalesce("ndcg", F.lit(0.0))), 4).alias("counted"))


@query("eval_summary_type", f"SELECT problem_type, count(*) AS cases, round(avg((recall + mrr) / 2), 4) AS combined_score FROM {CASES_SQL} GROUP BY 1")
def eval_summary_type(spark, sf_dir):
    return A.case_results(spark, sf_dir).groupBy("problem_type").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("recall") + F.col("mrr")) / 2), 4).alias("combined_score"))


@query("eval_summary_mode", f"SELECT mode, count(*) AS cases, count(*) FILTER (status = 'passed') AS passed, round(count(*) FILTER (status = 'passed') / count(*), 4) AS pass_rate FROM {CASES_SQL} GROUP BY 1")
def eval_summary_mode(spark, sf_dir):
    n = F.count_if(F.col("status") == "passed")
    return A.case_results(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("cases"), n.alias("passed"), F.round(n / F.count("*"), 4).alias("pass_rate"))


@query("trajectory_summary", f"WITH c AS (SELECT * FROM {CASES_SQL}) SELECT count(*) AS total_cases, round(avg(outcome_pass::INT), 4) AS outcome_pass_rate, round(avg(trajectory_pass::INT), 4) AS trajectory_pass_rate, round(avg(outcome_pass::INT) - avg(trajectory_pass::INT), 4) AS gap, list_sort(list(latency_ms))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS latency_p50, max(latency_ms) AS latency_max FROM c")
def trajectory_summary(spark, sf_dir):
    return E.trajectory_summary(A.case_results(spark, sf_dir))


@query("false_positives", f"SELECT case_id FROM {CASES_SQL} WHERE outcome_pass AND NOT trajectory_pass")
def false_positives(spark, sf_dir):
    return A.case_results(spark, sf_dir).where("outcome_pass AND NOT trajectory_pass").select("case_id")


@query("confidently_wrong", f"SELECT case_id FROM {CASES_SQL} WHERE mode = 'en' AND coalesce(mrr, 0) >= 0.9 AND coalesce(ndcg, 1) < 1")
def confidently_wrong(spark, sf_dir):
    """Cases of one failure mode with a high faithfulness and a retrieval that isn't whole."""
    return A.case_results(spark, sf_dir).where((F.col("mode") == "en") & (F.coalesce("mrr", F.lit(0.0)) >= 0.9) & (F.coalesce("ndcg", F.lit(1.0)) < 1)).select("case_id")


@query("pct_nearest_rank", f"SELECT arm, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.99) AS p99 FROM {ARMS_SQL} GROUP BY arm")
def pct_nearest_rank(spark, sf_dir):
    return A.arm_cases(spark, sf_dir).groupBy("arm").agg(E.nearest_rank("latency_ms", 0.5).alias("p50"), E.nearest_rank("latency_ms", 0.99).alias("p99"))


@query("median_trunc", f"SELECT arm, CAST(trunc(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS p50 FROM {ARMS_SQL} GROUP BY arm")
def median_trunc(spark, sf_dir):
    return A.arm_cases(spark, sf_dir).groupBy("arm").agg(F.expr("cast(percentile(latency_ms, 0.5) as bigint)").alias("p50"))


@query("upper_median", f"SELECT case_id, list_sort(list(latency_ms))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS p50, max(latency_ms) AS most FROM {ARMS_SQL} GROUP BY case_id")
def upper_median(spark, sf_dir):
    return A.arm_cases(spark, sf_dir).groupBy("case_id").agg(E.upper_median("latency_ms").alias("p50"), F.max("latency_ms").alias("most"))


_SUCCESS = "round(sum(cost) / nullif(count(*) FILTER (passed), 0), 9) AS cost_per_success"


@query("arm_summary", f"SELECT arm, round(count(*) FILTER (passed) / count(*), 3) AS pass_rate, CAST(trunc(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS p50_latency_ms, CAST(trunc(quantile_disc(latency_ms, 0.99)) AS BIGINT) AS p99_latency_ms, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost) / count(*), 9) AS cost_per_question, {_SUCCESS} FROM {ARMS_SQL} GROUP BY arm")
def arm_summary(spark, sf_dir):
    return E.arm_summary(A.arm_cases(spark, sf_dir))


_SQUAD = f"SELECT arm, count(*) AS case_count, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate, CAST(trunc(quantile_disc(latency_ms, 0.5)) AS BIGINT) AS p50_latency_ms, CAST(trunc(quantile_disc(latency_ms, 0.99)) AS BIGINT) AS p99_latency_ms, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS total_cost FROM {ARMS_SQL} WHERE latency_ms > 0 GROUP BY arm"


@query("squad_summary", _SQUAD)
def squad_summary(spark, sf_dir):
    return E.squad_summary(A.arm_cases(spark, sf_dir))


@query("arm_verdict", f"WITH s AS ({_SQUAD}) SELECT round(max(tokens) FILTER (arm = 'O') / max(tokens) FILTER (arm = 'F'), 1) AS multiplier, CASE WHEN max(pass_rate) FILTER (arm = 'O') > max(pass_rate) FILTER (arm = 'F') + 0.05 THEN 'KEEP' ELSE 'KILL' END AS verdict FROM s")
def arm_verdict(spark, sf_dir):
    of = lambda c, arm: F.max(F.when(F.col("arm") == arm, F.col(c)))
    return E.squad_summary(A.arm_cases(spark, sf_dir)).agg(F.round(of("tokens", "O") / of("tokens", "F"), 1).alias("multiplier"), E.verdict(of("pass_rate", "F"), of("pass_rate", "O")).alias("verdict"))


@query("arm_side_by_side", f"SELECT p_partkey AS case_id, coalesce(f.passed, 'N') AS single, coalesce(f.tokens, 0) AS single_tokens, coalesce(o.passed, 'N') AS squad, coalesce(o.tokens, 0) AS squad_tokens FROM part LEFT JOIN (SELECT case_id, CASE WHEN bool_and(passed) THEN 'Y' ELSE 'N' END AS passed, CAST(sum(tokens) AS BIGINT) AS tokens FROM {ARMS_SQL} WHERE arm = 'F' GROUP BY 1) f ON f.case_id = p_partkey LEFT JOIN (SELECT case_id, CASE WHEN bool_and(passed) THEN 'Y' ELSE 'N' END AS passed, CAST(sum(tokens) AS BIGINT) AS tokens FROM {ARMS_SQL} WHERE arm = 'O' GROUP BY 1) o ON o.case_id = p_partkey")
def arm_side_by_side(spark, sf_dir):
    """Both arms of every case; one pass over the cases, with conditional aggregates in place of two joins."""
    rows = A.arm_cases(spark, sf_dir)
    of = lambda arm: F.col("arm") == arm
    flag = lambda arm: F.when(F.bool_and(F.when(of(arm), F.col("passed"))), "Y").otherwise("N")
    both = rows.groupBy("case_id").agg(flag("F").alias("single"), F.sum(F.when(of("F"), F.col("tokens"))).alias("single_tokens"), flag("O").alias("squad"), F.sum(F.when(of("O"), F.col("tokens"))).alias("squad_tokens"))
    cases = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"))
    return cases.join(both, "case_id", "left").fillna("N", ["single", "squad"]).fillna(0, ["single_tokens", "squad_tokens"])


@query("bottleneck_argmax", f"SELECT arm, arg_max(l_orderkey * 10 + l_linenumber, tokens * 1000000000 - (l_orderkey * 10 + l_linenumber)) AS handoff, max(tokens) AS tokens, round(100.0::DOUBLE * max(tokens) / sum(tokens), 1) AS share FROM {ARMS_SQL} GROUP BY arm")
def bottleneck_argmax(spark, sf_dir):
    """The handoff with most tokens, the first of equals, and its share."""
    h = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = A.arm_cases(spark, sf_dir).groupBy("arm").agg(F.max(F.struct("tokens", (-h).alias("h"))).alias("m"), F.sum("tokens").alias("total"))
    return rows.select("arm", (-F.col("m.h")).alias("handoff"), F.col("m.tokens").alias("tokens"), F.round(F.lit(100.0) * F.col("m.tokens") / F.col("total"), 1).alias("share"))


_JUDGE = "(SELECT doc_id, quality AS human, CASE WHEN doc_id % 6 <> 0 THEN 1 - toxic END AS judge, doc_id % 4 <> 0 AS keyworded FROM labels)"


@query("judge_agreement", f"SELECT count(*) FILTER (keyworded AND judge IS NOT NULL) AS graded, count(*) FILTER (keyworded AND human = judge) AS agreed, round(count(*) FILTER (keyworded AND human = judge) / nullif(count(*) FILTER (keyworded AND judge IS NOT NULL), 0), 4) AS agreement, count(*) FILTER (keyworded AND judge IS NULL) AS ungraded, count(*) FILTER (NOT keyworded) AS ungrounded FROM {_JUDGE}")
def judge_agreement(spark, sf_dir):
    i = F.col("doc_id")
    return E.judge_agreement(table(spark, sf_dir, "labels").select(F.col("quality").alias("human"), F.when(i % 6 != 0, 1 - F.col("toxic")).alias("judge"), (i % 4 != 0).alias("keyworded")))


@query("label_join", f"SELECT doc_id AS case_id, quality AS label, status FROM labels JOIN {CASES_SQL} c ON c.case_id = doc_id")
def label_join(spark, sf_dir):
    """Labels with their cases; those without one are dropped."""
    return E.labelled(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("label")), A.case_results(spark, sf_dir).select("case_id", "status"))


_SIDES = f"(SELECT * FROM {CASES_SQL} WHERE case_id % 2 = 0 AND mode <> 'es') b"
_MATRIX = f"""WITH b AS (SELECT mode, count(*) AS c, count(*) FILTER (NOT trajectory_pass) AS f FROM {CASES_SQL} WHERE case_id % 2 = 0 AND mode <> 'es' GROUP BY 1), a AS (SELECT mode, count(*) AS c, count(*) FILTER (NOT trajectory_pass) AS f FROM {CASES_SQL} WHERE case_id % 2 = 1 AND mode <> 'de' GROUP BY 1)
SELECT coalesce(a.mode, b.mode) AS mode, coalesce(b.c, 0) AS before_count, coalesce(b.f, 0) AS before_fails, coalesce(a.c, 0) AS after_count, coalesce(a.f, 0) AS after_fails, b.c IS NULL AS is_new, coalesce(a.f, 0) > coalesce(b.f, 0) AS worsened, coalesce(a.f, 0) < coalesce(b.f, 0) AS improved, coalesce(a.f, 0) = coalesce(b.f, 0) AS unchanged FROM a FULL JOIN b ON a.mode = b.mode"""


@query("regression_matrix", _MATRIX)
def regression_matrix(spark, sf_dir):
    c = A.case_results(spark, sf_dir)
    return E.regression_matrix(c.where("case_id % 2 = 0 AND mode <> 'es'"), c.where("case_id % 2 = 1 AND mode <> 'de'"))


@query("mitigation_delta", f"SELECT count(*) FILTER (case_id % 2 = 0 AND NOT trajectory_pass) - count(*) FILTER (case_id % 2 = 1 AND NOT trajectory_pass) AS failures_removed, (list_sort(list(latency_ms) FILTER (case_id % 2 = 1)))[CAST(floor(count(*) FILTER (case_id % 2 = 1) / 2) AS BIGINT) + 1] - (list_sort(list(latency_ms) FILTER (case_id % 2 = 0)))[CAST(floor(count(*) FILTER (case_id % 2 = 0) / 2) AS BIGINT) + 1] AS p50_change FROM {CASES_SQL}")
def mitigation_delta(spark, sf_dir):
    c = A.case_results(spark, sf_dir)
    side = lambda n: E.trajectory_summary(c.where(f"case_id % 2 = {n}"))
    fails = c.agg((F.count_if((F.col("case_id") % 2 == 0) & ~F.col("trajectory_pass")) - F.count_if((F.col("case_id") % 2 == 1) & ~F.col("trajectory_pass"))).alias("failures_removed"))
    b, a = side(0).select(F.col("latency_p50").alias("b")), side(1).select(F.col("latency_p50").alias("a"))
    return fails.crossJoin(b).crossJoin(a).select("failures_removed", (F.col("a") - F.col("b")).alias("p50_change"))


@query("prev_run_asof", "SELECT o_orderkey AS run_id, o_orderpriority AS strategy, o_totalprice AS score, lag(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS prev_score FROM orders")
def prev_run_asof(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("strategy"), F.col("o_totalprice").alias("score"), "o_orderdate")
    return E.previous_run(runs, "strategy", F.asc("o_orderdate"), F.asc("run_id")).drop("o_orderdate")


@query("delta_by_type", f"WITH p AS (SELECT problem_type, round(avg(mrr), 4) AS s FROM {CASES_SQL} WHERE case_id % 2 = 0 GROUP BY 1), c AS (SELECT problem_type, round(avg(mrr), 4) AS s FROM {CASES_SQL} WHERE case_id % 2 = 1 AND problem_type <> 'src3' GROUP BY 1) SELECT p.problem_type, p.s AS before, coalesce(c.s, 0) AS after, round(coalesce(c.s, 0) - p.s, 4) AS delta FROM p LEFT JOIN c USING (problem_type)")
def delta_by_type(spark, sf_dir):
    c = A.case_results(spark, sf_dir)
    side = lambda df, n: df.groupBy("problem_type").agg(F.round(F.avg("mrr"), 4).alias(n))
    joined = side(c.where("case_id % 2 = 0"), "before").join(side(c.where("case_id % 2 = 1 AND problem_type <> 'src3'"), "after"), "problem_type", "left").fillna(0.0, ["after"])
    return joined.withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


# --- judged claims and answers -------------------------------------------------------------------------------------
@query("context_precision", f"WITH {S.bm25_ctes(10)}, j AS (SELECT query_id, rank, chunk_id % 3 = 0 AS rel FROM bm), h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM j) SELECT query_id, CASE WHEN sum(rel::INT) = 0 THEN 0 ELSE round(sum(CASE WHEN rel THEN hits / rank ELSE 0 END) / sum(rel::INT), 6) END AS context_precision FROM h GROUP BY query_id")
def context_precision(spark, sf_dir):
    rows = R.bm25_search(A.questions(spark, sf_dir), A.chunks(spark, sf_dir), 10)
    return E.context_precision(rows.select("query_id", "rank", (F.col("chunk_id") % 3 == 0).alias("relevant")))


@query("claim_faithfulness", "SELECT conv_id, CASE WHEN count(*) FILTER (turn % 5 <> 4) = 0 THEN NULL ELSE round(count(*) FILTER (turn % 5 <> 4 AND turn % 2 = 0) / count(*) FILTER (turn % 5 <> 4), 4) END AS faithfulness FROM conversations GROUP BY conv_id")
def claim_faithfulness(spark, sf_dir):
    """Supported among judged claims; null without any."""
    judged = table(spark, sf_dir, "conversations").where("turn % 5 <> 4 OR turn IS NULL").select("conv_id", (F.col("turn") % 2 == 0).alias("supported"))
    every = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    rate = judged.groupBy("conv_id").agg(F.round(F.count_if("supported") / F.count("*"), 4).alias("faithfulness"))
    return every.join(rate, "conv_id", "left")


@query("kw_all_pass", f"SELECT case_id, len(list_filter(keywords, lambda k: NOT contains(lower(answer), lower(k)))) = 0 AS passed FROM {ANSWERS_SQL}")
def kw_all_pass(spark, sf_dir):
    return A.answers(spark, sf_dir).select("case_id", T.holds_all(F.col("answer"), F.col("keywords")).alias("passed"))


@query("kw_fraction", f"SELECT case_id, round(CASE WHEN len(keywords) = 0 THEN 1 ELSE len(list_filter(keywords, lambda k: contains(lower(answer), lower(k)))) / len(keywords) END, 6) AS score FROM {ANSWERS_SQL}")
def kw_fraction(spark, sf_dir):
    return A.answers(spark, sf_dir).select("case_id", F.round(T.keyword_share(F.col("answer"), F.col("keywords")), 6).alias("score"))


def _share(words: str, text: str, n: int) -> str:
    kept = f"list_distinct(list_filter({S.words(f'lower({words})')}, lambda w: length(w) > {n}))"
    return f"CASE WHEN len({kept}) = 0 THEN 0 ELSE round(len(list_filter({kept}, lambda w: contains(lower({text}), w))) / len({kept}), 4) END"


_REFUSED = f"regexp_matches(lower(answer), '^\\s*$|{'|'.join(T.REFUSAL_PHRASES).replace(chr(39), chr(39) * 2)}')"


@query("answer_relevance", f"SELECT case_id, CASE WHEN {_REFUSED} THEN 0 ELSE {_share('question', 'answer', 3)} END AS relevance FROM {ANSWERS_SQL}")
def answer_relevance(spark, sf_dir):
    return A.answers(spark, sf_dir).select("case_id", F.when(T.is_refusal(F.col("answer")), F.lit(0.0)).otherwise(T.word_share(F.col("question"), F.col("answer"), 3)).alias("relevance"))


@query("faithfulness_heur", f"SELECT case_id, CASE WHEN {_REFUSED} THEN 0 ELSE {_share('answer', 'question', 4)} END AS faithfulness FROM {ANSWERS_SQL}")
def faithfulness_heur(spark, sf_dir):
    return A.answers(spark, sf_dir).select("case_id", F.when(T.is_refusal(F.col("answer")), F.lit(0.0)).otherwise(T.word_share(F.col("answer"), F.col("question"), 4)).alias("faithfulness"))


@query("agent_vs_baseline", f"""WITH a AS (SELECT case_id, {_share('question', 'answer', 3)} AS agent, CASE WHEN length(answer) % 4 <> 0 THEN {_share('answer', 'question', 4)} END AS baseline FROM {ANSWERS_SQL})
SELECT count(*) AS cases, round(avg(agent), 4) AS agent, round(avg(baseline), 4) AS baseline, count(*) FILTER (agent > baseline) AS agent_wins, count(*) FILTER (agent < baseline) AS baseline_wins FROM a""")
def agent_vs_baseline(spark, sf_dir):
    """Two systems over the same cases; averages leave out what is missing."""
    a = A.answers(spark, sf_dir).select(T.word_share(F.col("question"), F.col("answer"), 3).alias("agent"), F.when(F.length("answer") % 4 != 0, T.word_share(F.col("answer"), F.col("question"), 4)).alias("baseline"))
    return a.agg(F.count("*").alias("cases"), F.round(F.avg("agent"), 4).alias("agent"), F.round(F.avg("baseline"), 4).alias("baseline"), F.count_if(F.col("agent") > F.col("baseline")).alias("agent_wins"), F.count_if(F.col("agent") < F.col("baseline")).alias("baseline_wins"))


_ENDPOINTS = f"SELECT DISTINCT query_id FROM (SELECT query_id, unnest(regexp_extract_all(answer, '/[A-Za-z][A-Za-z0-9_\\-{{}}]*(?:/[A-Za-z0-9_\\-{{}}]+)*')) AS endpoint FROM ans) WHERE endpoint NOT IN ({S.quoted(checks.TEMPLATES)}) AND len(list_filter({checks._RX}, lambda r: regexp_matches(endpoint, r))) = 0"
_CASE_SCORE = f"""{_IR}, ans AS (SELECT query_id, text AS answer FROM bm JOIN documents ON doc_id = chunk_id WHERE rank = 1),
viol AS ({_ENDPOINTS} UNION SELECT query_id FROM ans, {checks._DEP} WHERE regexp_matches(lower(answer), p) AND len(list_filter(w, lambda x: contains(lower(answer), x))) = 0),
kw AS (SELECT item_id AS query_id, list_slice({S.words('text')}, 1, 3) AS k FROM benchmark),
s AS (SELECT b.item_id AS query_id, coalesce(recall, 0) AS retrieval_score, CASE WHEN b.item_id % 4 = 0 THEN CASE WHEN b.item_id % 8 = 0 THEN 1.0::DOUBLE ELSE 0.0 END
  ELSE round(CASE WHEN len(k) = 0 THEN 1 ELSE len(list_filter(k, lambda x: contains(lower(coalesce(answer, '')), lower(x)))) / len(k) END, 6) END AS answer_score, v.query_id IS NOT NULL AS violates
  FROM benchmark b LEFT JOIN r ON r.query_id = b.item_id LEFT JOIN ans a ON a.query_id = b.item_id LEFT JOIN viol v ON v.query_id = b.item_id JOIN kw ON kw.query_id = b.item_id)
SELECT query_id, retrieval_score, answer_score, round((retrieval_score + answer_score) / 2, 6) AS combined_score, CASE WHEN (retrieval_score + answer_score) / 2 = 1 AND NOT violates THEN 'passed' ELSE 'failed' END AS status FROM s"""


@query("devdocs_case_score", _CASE_SCORE)
def devdocs_case_score(spark, sf_dir):
    """Cases scored by their parts: the share of expected sources that were found, a judge's verdict or else the share of keywords
    in the answer, and the checks of endpoints and deprecations. The first chunk found stands for the answer; every fourth case has a verdict."""
    q = A.questions(spark, sf_dir)
    first = R.bm25_search(q, A.chunks(spark, sf_dir), 1).join(A.chunks(spark, sf_dir).select("chunk_id", F.col("content").alias("answer")), "chunk_id").select("query_id", "answer")
    i = F.col("query_id")
    cases = q.select("query_id", F.slice(T.space_words(F.col("query")), 1, 3).alias("keywords"), F.when(i % 4 == 0, i % 8 == 0).alias("verdict")).join(first, "query_id", "left")
    answers = first.select(F.col("query_id").alias("case_id"), "answer")
    hits = checks.C.unknown_endpoints(answers, spark.createDataFrame([(t,) for t in checks.TEMPLATES], "path string")).select("case_id")
    old = checks.C.deprecation_violations(answers, spark.createDataFrame(checks.DEPRECATIONS, "entry int, symbols array<string>, note string")).select("case_id")
    return E.case_scores(cases, _metrics(spark, sf_dir).select("query_id", "recall"), hits.union(old).select(F.col("case_id").alias("query_id")))


# --- trajectories --------------------------------------------------------------------------------------------------
def _steps(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s"))
    return rows.select("conv_id", F.transform("s", lambda s: s["role"]).alias("tools"))


_STEPS = "(SELECT conv_id, list(role ORDER BY turn) AS tools FROM conversations GROUP BY conv_id)"
_PATHS = [["user", "assistant"], ["user", "assistant", "user", "assistant"], ["system", "user", "assistant"]]
_PATHS_SQL = "[" + ", ".join("[" + S.quoted(p) + "]" for p in _PATHS) + "]"


def _paths():
    return F.array(*(F.array(*map(F.lit, p)) for p in _PATHS))


@query("tool_choice_accuracy", f"SELECT conv_id, round(len(list_filter(range(1, len(tools) + 1), lambda i: len(list_filter({_PATHS_SQL}, lambda p: p[i] = tools[i])) > 0)) / len(tools), 6) AS accuracy FROM {_STEPS}")
def tool_choice_accuracy(spark, sf_dir):
    """Share of steps whose tool some accepted path has at that place."""
    good = F.filter(F.transform("tools", lambda t, i: F.exists(_paths(), lambda p: F.coalesce(F.get(p, i) == t, F.lit(False)))), lambda b: b)
    return _steps(spark, sf_dir).select("conv_id", F.round(F.size(good) / F.size("tools"), 6).alias("accuracy"))


@query("step_efficiency", f"SELECT conv_id, round(least(1, 2 / len(tools)), 6) AS efficiency FROM {_STEPS}")
def step_efficiency(spark, sf_dir):
    return _steps(spark, sf_dir).select("conv_id", F.round(F.least(F.lit(1.0), F.lit(2) / F.size("tools")), 6).alias("efficiency"))


@query("trajectory_match", f"SELECT conv_id, list_contains({_PATHS_SQL}, tools) AS matched FROM {_STEPS}")
def trajectory_match(spark, sf_dir):
    return _steps(spark, sf_dir).select("conv_id", F.array_contains(_paths(), F.col("tools")).alias("matched"))


@query("arg_validity", "SELECT conv_id, round(avg(CASE WHEN role IN ('user', 'assistant') AND try_cast(substr(text, 1, 1) AS INT) IS NULL THEN 1 ELSE 0 END), 6) AS validity FROM conversations GROUP BY conv_id")
def arg_validity(spark, sf_dir):
    """Share of steps with a known tool and arguments of the right type."""
    valid = F.col("role").isin("user", "assistant") & F.substring("text", 1, 1).try_cast("int").isNull()
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.round(F.avg(valid.cast("int")), 6).alias("validity"))
