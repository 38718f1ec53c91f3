"""Trace search, spans, limits and pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from granary.operators import storage as ST, traces as TR
from granary.registry import query
from granary.session import table
from granary.sources import adapters as A
from granary.sources.adapters import SPANS_SQL, TRACES_SQL


def _search(name: str, where: str, **filters) -> None:
    def run(spark, sf_dir):
        return TR.search(A.traces(spark, sf_dir), TR.TraceFilter(**filters)).select("id", "status", "total_latency_ms")

    query(name, f"SELECT id, status, total_latency_ms FROM {TRACES_SQL} WHERE {where}")(run)


_search("trace_filter_eq", "status = 'completed' AND prompt_version = 'v1' AND kind = 'view'", status="completed", prompt_version="v1", mode="view")
_search("trace_filter_or", "(request_id = 42 OR session_id = 42) AND (provider = 'm2' OR model = 'm2')", request_id=42, model="m2")
_search("trace_filter_exists", "list_contains(source_ids, 17)", chunk_id=17)
_search("trace_filter_range", "coalesce(total_latency_ms, 0) >= 50 AND coalesce(cost_usd, 0) >= 0.00001 AND \"timestamp\" BETWEEN '2024-01-05' AND '2024-01-12'", min_latency_ms=50, min_cost_usd=0.00001, started_after=datetime(2024, 1, 5), started_before=datetime(2024, 1, 12))
_search("trace_filter_error", "coalesce(error, '') <> ''", error=True)


@query("point_lookup", f"SELECT id, status FROM {TRACES_SQL} WHERE id = 77")
def point_lookup(spark, sf_dir):
    return TR.search(A.traces(spark, sf_dir), TR.TraceFilter(trace_id=77)).limit(1).select("id", "status")


@query("trace_topn", f'SELECT id, "timestamp" FROM {TRACES_SQL} WHERE status = \'completed\' ORDER BY "timestamp" DESC NULLS LAST, id DESC LIMIT 50')
def trace_topn(spark, sf_dir):
    return TR.search(A.traces(spark, sf_dir), TR.TraceFilter(status="completed"), 50).select("id", "timestamp")


@query("trace_list", f"SELECT id, kind FROM {TRACES_SQL} ORDER BY id DESC LIMIT 20")
def trace_list(spark, sf_dir):
    """The last inserted first."""
    return A.traces(spark, sf_dir).orderBy(F.desc("id")).limit(20).select("id", "kind")


@query("page_slice", f'SELECT id FROM {TRACES_SQL} ORDER BY "timestamp" DESC, id DESC LIMIT 25 OFFSET 50')
def page_slice(spark, sf_dir):
    return ST.page_of(A.traces(spark, sf_dir).select("id", "timestamp"), 3, 25, F.desc("timestamp"), F.desc("id")).select("id")


@query("offset_limit", "SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_name, p_partkey LIMIT 100 OFFSET 20")
def offset_limit(spark, sf_dir):
    """A slice of at most 100, with the number of all rows."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.orderBy("p_name", "p_partkey").offset(20).limit(min(500, 100)).crossJoin(p.agg(F.count("*").alias("total")))


@query("runs_sorted", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS started FROM orders")
def runs_sorted(spark, sf_dir):
    """Runs by start, newest first; those without one last."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("started"))
    return o.orderBy(F.desc_nulls_last("started"), "o_orderkey")


@query("span_totals", f"SELECT trace_id, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost, count(*) AS spans FROM {SPANS_SQL} GROUP BY 1")
def span_totals(spark, sf_dir):
    return TR.span_totals(A.spans(spark, sf_dir))


_TREE = f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ts, span_id) AS no FROM {SPANS_SQL}),
s AS (SELECT n.trace_id, n.span_id, CASE WHEN n.span_id % 17 = 0 THEN NULL ELSE p.span_id END AS up, n.tokens, n.cost FROM n LEFT JOIN n p ON p.trace_id = n.trace_id AND p.no = CASE WHEN length(n.trace_id) % 2 = 0 THEN n.no - 1 ELSE n.no // 2 END),
a(trace_id, span_id, anc, d) AS (SELECT trace_id, span_id, span_id, 0 FROM s UNION ALL SELECT a.trace_id, a.span_id, s.up, a.d + 1 FROM a JOIN s ON s.trace_id = a.trace_id AND s.span_id = a.anc WHERE s.up IS NOT NULL),
t AS (SELECT a.trace_id, a.anc AS span_id, count(*) AS spans, CAST(sum(s.tokens) AS BIGINT) AS all_tokens, round(sum(s.cost), 6) AS all_cost FROM a JOIN s ON s.trace_id = a.trace_id AND s.span_id = a.span_id GROUP BY 1, 2),
d AS (SELECT trace_id, span_id, CAST(max(d) AS BIGINT) AS depth FROM a GROUP BY 1, 2)
SELECT s.trace_id, s.span_id, depth, s.tokens, round(s.cost, 6) AS cost, spans, all_tokens, all_cost FROM s JOIN t USING (trace_id, span_id) JOIN d USING (trace_id, span_id)"""


@query("span_tree_totals", _TREE)
def span_tree_totals(spark, sf_dir):
    """Own and inclusive totals of spans whose parents are chains in some traces and trees in others; some parents are missing."""
    from pyspark.sql import Window

    n = A.spans(spark, sf_dir).withColumn("no", F.row_number().over(Window.partitionBy("trace_id").orderBy("start_ts", "span_id")))
    above = n.select("trace_id", F.col("no").alias("up_no"), F.col("span_id").alias("parent"))
    up = F.when(F.length("trace_id") % 2 == 0, F.col("no") - 1).otherwise(F.floor(F.col("no") / 2))
    joined = n.withColumn("up_no", up.cast("int")).join(above, ["trace_id", "up_no"], "left")
    return TR.span_tree_totals(joined.withColumn("parent_span_id", F.when(F.col("span_id") % 17 == 0, -F.col("span_id") - 1).otherwise(F.col("parent"))))


@query("cost_by_stage", f"SELECT CASE WHEN stage IN ('view', 'click') THEN 'retrieval' WHEN stage = 'purchase' THEN 'generation' ELSE 'other' END AS category, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM {SPANS_SQL} GROUP BY 1")
def cost_by_stage(spark, sf_dir):
    return TR.cost_by_stage(A.spans(spark, sf_dir))


@query("span_duration", f"SELECT span_id, datediff('millisecond', start_ts, end_ts) AS duration_ms FROM {SPANS_SQL}")
def span_duration(spark, sf_dir):
    return A.spans(spark, sf_dir).select("span_id", F.timestamp_diff("MILLISECOND", "start_ts", "end_ts").alias("duration_ms"))


@query("cost_usd", "SELECT event_id, round(CAST(json_extract_string(props, '$.k') AS BIGINT) * 0.0000005::DOUBLE, 9) AS cost FROM events")
def cost_usd(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(F.get_json_object("props", "$.k").cast("long") * F.lit(0.0000005), 9).alias("cost"))


@query("sliding_60s", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_60s(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), "ts")
    return TR.sliding_count(e).select("event_id", "n")


@query("budget_stop", """WITH s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no, value AS seconds, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
b AS (SELECT run, no, CASE WHEN coalesce(sum(seconds) OVER w, 0) >= 120 THEN 'wall_clock' WHEN coalesce(sum(k * 0.00005::DOUBLE) OVER w, 0) >= 0.01 THEN 'cost' WHEN coalesce(sum(k * 10) OVER w, 0) >= 2000 THEN 'tokens' END AS reason FROM s WINDOW w AS (PARTITION BY run ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run, coalesce(min(no) FILTER (reason IS NOT NULL), count(*) + 1) AS stop_step, coalesce(arg_min(reason, no) FILTER (reason IS NOT NULL), 'finished') AS reason FROM b WHERE no <= 5 GROUP BY run""")
def budget_stop(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("step"), F.col("value").alias("seconds"), (k * F.lit(0.00005)).alias("cost"), (k * 10).alias("tokens"))
    return TR.budget_stop(steps)


@query("backoff_delay", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value ELSE 2 * pow(2, event_id % 3) END AS delay FROM events")
def backoff_delay(spark, sf_dir):
    """A server's own delay, or twice two to the attempt."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(i % 4 == 0, F.col("value")), F.lit(2.0) * F.pow(F.lit(2.0), i % 3)).alias("delay"))


@query("dup_query_guard", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) > 1 AS repeated FROM conversations")
def dup_query_guard(spark, sf_dir):
    """A query that its run has asked before."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn")) > 1).alias("repeated"))
