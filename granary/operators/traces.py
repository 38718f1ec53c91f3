"""Search and roll-ups of traces and spans."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.sources.tables import written


@dataclass(frozen=True)
class TraceFilter:
    """Predicates of a search; those that are None, and texts that are empty, don't count."""

    trace_id: int | None = None
    request_id: int | None = None
    status: str | None = None
    prompt_version: str | None = None
    model: str | None = None
    mode: str | None = None
    chunk_id: int | None = None
    error: bool | None = None
    min_latency_ms: float | None = None
    min_cost_usd: float | None = None
    started_after: datetime | None = None
    started_before: datetime | None = None

    def conditions(self) -> list[Column]:
        out: list[Column] = []
        if self.trace_id is not None:
            out.append(F.col("id") == self.trace_id)
        if self.request_id is not None:
            out.append((F.col("request_id") == self.request_id) | (F.col("session_id") == self.request_id))
        if self.status:
            out.append(F.col("status") == self.status)
        if self.prompt_version:
            out.append(F.col("prompt_version") == self.prompt_version)
        if self.model:
            out.append((F.col("provider") == self.model) | (F.col("model") == self.model))
        if self.mode:
            out.append(F.col("kind") == self.mode)
        if self.chunk_id is not None:
            out.append(F.exists("sources", lambda s: s["chunk_id"] == self.chunk_id))
        if self.error is not None:
            failed = F.coalesce(F.col("error"), F.lit("")) != ""
            out.append(failed if self.error else ~failed)
        if self.min_latency_ms is not None:
            out.append(F.coalesce("total_latency_ms", F.lit(0.0)) >= self.min_latency_ms)
        if self.min_cost_usd is not None:
            out.append(F.coalesce("cost_usd", F.lit(0.0)) >= self.min_cost_usd)
        if self.started_after is not None:
            out.append(F.col("timestamp") >= F.lit(self.started_after).cast("timestamp_ntz"))
        if self.started_before is not None:
            out.append(F.col("timestamp") <= F.lit(self.started_before).cast("timestamp_ntz"))
        return out


def search(traces: DataFrame, wanted: TraceFilter, limit: int | None = None) -> DataFrame:
    """Traces that meet every condition; with a limit the newest, those without a time last."""
    for condition in wanted.conditions():
        traces = traces.where(condition)
    return traces if limit is None else traces.orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(limit)


def span_totals(spans: DataFrame) -> DataFrame:
    """trace_id, tokens, cost (6 places), spans."""
    return spans.groupBy("trace_id").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("spans"))


def stage_category(stage: Column) -> Column:
    """Kind of a stage: retrieval, generation, tool or other."""
    return F.when(stage.isin("view", "click") | stage.startswith("retrieval."), "retrieval").when(stage.isin("purchase") | stage.startswith("generation"), "generation").when(stage.startswith("tool"), "tool").otherwise("other")


def cost_by_stage(spans: DataFrame) -> DataFrame:
    return spans.groupBy(stage_category(F.col("stage")).alias("category")).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def span_tree_totals(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, depth, tokens, cost, spans, all_tokens, all_cost of spans(trace_id, span_id, parent_span_id, tokens, cost): own totals and those with all spans below.

    A parent that its trace doesn't have, and a span that is its own parent, make a root, of depth 0. Spans in a circle of
    parents or below one have null depth, spans, all_tokens and all_cost. Null tokens and costs count 0.

    By pointer doubling: after k rounds a span knows the sums of all spans fewer than 2^k steps below it and its ancestor
    2^k steps above, to which it then adds its own sums. A chain of a million spans takes twenty rounds, each of two joins
    on equal keys and of as many rows as there are spans.
    """
    own = spans.select("trace_id", "span_id", F.col("parent_span_id").alias("up"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    ids = own.select("trace_id", F.col("span_id").alias("up"))
    placed = own.where(F.col("up") != F.col("span_id")).join(ids, ["trace_id", "up"]).select("trace_id", "span_id", "up")
    state = own.drop("up").join(placed, ["trace_id", "span_id"], "left").select(
        "trace_id", "span_id", "tokens", "cost", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("spans"), F.col("tokens").alias("all_tokens"), F.col("cost").alias("all_cost"),
    )
    state = written(state, "span-tree")
    longest = own.groupBy("trace_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(max(0, longest - 1).bit_length()):
        if state.where("up IS NOT NULL").isEmpty():
            break
        below = state.where("up IS NOT NULL").groupBy("trace_id", "up").agg(*(F.sum(c).alias(f"more_{c}") for c in ("spans", "all_tokens", "all_cost"))).withColumnRenamed("up", "span_id")
        above = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more_depth"))
        joined = state.join(above, ["trace_id", "up"], "left").join(below, ["trace_id", "span_id"], "left")
        more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        state = written(joined.select("trace_id", "span_id", "tokens", "cost", F.col("next").alias("up"), *map(more, ("depth", "spans", "all_tokens", "all_cost"))), "span-tree")
    # a span that still has an ancestor has more of them than its trace has spans
    tree = lambda c: F.when(F.col("up").isNull(), F.col(c))
    return state.select("trace_id", "span_id", tree("depth").alias("depth"), "tokens", F.round("cost", 6).alias("cost"), tree("spans").alias("spans"), tree("all_tokens").alias("all_tokens"), F.round(tree("all_cost"), 6).alias("all_cost"))


def sliding_count(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Adds n: requests of the same client in the given seconds up to each."""
    w = f"count(*) over (partition by client order by ts range between interval {seconds} seconds preceding and current row)"
    return requests.withColumn("n", F.expr(w))


def budget_stop(steps: DataFrame, seconds: float = 120, cost: float = 0.01, tokens: int = 2000, most_steps: int = 5) -> DataFrame:
    """run, stop_step, reason of steps(run, step, seconds, cost, tokens): the first step before which a budget is spent.

    Budgets are looked at before each step, time first, then cost, then tokens; a run that spends none ends after
    its last step, of most_steps at most.
    """
    before = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    reason = F.when(spent("seconds") >= seconds, "wall_clock").when(spent("cost") >= cost, "cost").when(spent("tokens") >= tokens, "tokens")
    rows = steps.withColumns({"no": F.row_number().over(Window.partitionBy("run").orderBy("step")), "reason": reason}).where(F.col("no") <= most_steps)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("no", "reason")))
    return rows.groupBy("run").agg(first.alias("f"), F.count("*").alias("n")).select("run", F.coalesce(F.col("f.no").cast("long"), F.col("n") + 1).alias("stop_step"), F.coalesce("f.reason", F.lit("finished")).alias("reason"))
