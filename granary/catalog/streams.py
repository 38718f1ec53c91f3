"""Rate limits, event counts, agent steps and server-sent events."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.registry import query
from granary.session import table
from granary.sources import files
from granary.streaming import delivery as D, stateful as SS


@query("rate_limit_admit")
def rate_limit_admit(spark, sf_dir):
    """Compared with a plain model in the tests."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "ts")
    return SS.rate_limit(e, 2, 3600)


@query("rate_limit_stream")
def rate_limit_stream(spark, sf_dir):
    """The stream of all events through the limiter, whose clients' state expires; equal to rate_limit_admit, as the tests show."""
    out, mark = files.shared_path(spark, "admitted"), files.shared_path(spark, "mark")
    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*")
    requests = stream.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    SS.run_available(SS.rate_limit_stream(requests, 2, 3600), out, mark)
    return spark.read.parquet(out)


@query("event_delivery", """SELECT user_id AS trace, event_id AS seq, event_type AS type, props AS data FROM events
UNION ALL SELECT user_id, max(event_id) + 1, '[DONE]', NULL FROM events GROUP BY user_id""")
def event_delivery(spark, sf_dir):
    """All events as a stream into a table keyed by trace and number, with an end mark for every trace. Which event is a trace's last comes from a table."""
    out, mark = files.shared_path(spark, "events"), files.shared_path(spark, "mark")
    e = table(spark, sf_dir, "events")
    ends = e.groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("last", F.lit(True))
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*").join(ends, ["user_id", "event_id"], "left")
    D.deliver(stream.select(F.col("user_id").alias("trace"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("props").alias("data"), F.coalesce("last", F.lit(False)).alias("last")), out, mark)
    return D.delivered(spark, out)


@query("client_id", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 250) WHEN event_id % 3 = 1 THEN 'peer' || user_id ELSE 'peer' || user_id END AS client FROM events")
def client_id(spark, sf_dir):
    i = F.col("event_id") % 3
    head = F.when(i == 0, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" , 1.2.3.4"))).when(i == 1, F.lit(" , 9.9.9.9"))
    return table(spark, sf_dir, "events").select("event_id", SS.client_id(head, F.concat(F.lit("peer"), "user_id")).alias("client"))


@query("event_counts", "SELECT event_type AS stage, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark, sf_dir):
    """Counts by stage and hour of a file stream, run over all that is there; each batch replaces the table of counts."""
    out, mark = files.shared_path(spark, "counts"), files.shared_path(spark, "mark")
    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*").select("ts", F.col("event_type").alias("stage"))
    q = SS.event_counts(stream, "1 hour").writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("events_to_steps", "SELECT conv_id AS run, turn AS step, 'because ' || role AS reason, role AS tool, length(text) AS latency_ms, text AS observation FROM conversations")
def events_to_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kinds = {"reason": F.concat(F.lit("because "), "role"), "action.start": F.col("role"), "action.done": F.length("text").cast("string"), "observation": F.col("text")}
    events = c.select(F.col("conv_id").alias("run"), F.col("turn").alias("step"), F.explode(F.array(*(F.struct(F.lit(k).alias("type"), v.alias("data")) for k, v in kinds.items()))).alias("e")).select("run", "step", "e.*")
    return SS.fold_steps(events)


@query("sse_parse", "SELECT conv_id, string_agg(role || ' ', '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def sse_parse(spark, sf_dir):
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.concat("role", F.lit(" ")).alias("content")).alias("delta"))).alias("choices"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("l"))
    lines = F.concat(F.array(F.lit(": ping"), F.lit("data: {}")), F.transform("l", lambda x: x["l"]), F.array(F.lit("data: [DONE]"), F.lit('data: {"choices":[{"delta":{"content":"late"}}]}')))
    return c.select("conv_id", SS.sse_content(lines).alias("content"))
