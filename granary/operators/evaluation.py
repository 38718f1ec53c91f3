"""Retrieval and answer metrics, averages and breakdowns of graded cases, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions import text as T
from granary.session import bounded_broadcast
from granary.sources.tables import written

#: Members of a group that meet as one in pairs_within(); pairs of a task's cell are its square at most, or near to it.
PAIR_ROWS = 2048
METRICS = ["hit_rate", "recall", "precision", "mrr", "ndcg", "latency_ms"]

# The failure categories that a histogram shows, in order.
FAILURES = [
    "retrieval_failure", "missing_source", "wrong_source", "poor_ranking", "poor_context", "poor_answer", "citation_failure", "latency_failure",
    "token_limit_failure", "llm_failure", "prompt_issue",
]


def source_keys(chunk_id: Column, document: Column, page: Column) -> Column:
    """Every identity of a source: its chunk and its document and page."""
    chunk = F.when(chunk_id.isNotNull(), F.concat(F.lit("chunk:"), chunk_id.cast("string")))
    name = T.document_key(F.coalesce(document, F.lit("")))
    doc = F.when(name != "", F.concat(F.lit("doc:"), name, F.lit("|"), F.coalesce(page.cast("string"), F.lit("None"))))
    return F.array_compact(F.array(chunk, doc))


def source_matches(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct query_id, rank, exp_no of retrieved(query_id, rank, keys) and expected(query_id, exp_no, keys) that share a key; an equi-join on exploded keys."""
    r = retrieved.select("query_id", "rank", F.explode("keys").alias("key"))
    e = expected.select("query_id", "exp_no", F.explode("keys").alias("key"))
    return r.join(e, ["query_id", "key"]).select("query_id", "rank", "exp_no").distinct()


def pairs_within(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct item, other of the rows(item, *keys) that share all keys, each item with itself too; a null key is shared with none.

    The result is the product of each group with itself by its nature, so a group above PAIR_ROWS is cut by hash, and each cell of
    its product is a key of its own: tasks are many and of a like size. Rows are made distinct before they meet, after which
    only items that are in several groups can meet twice; their pairs alone are made distinct again.
    """
    spark = rows.sparkSession
    own = rows.select("item", *keys).dropna(subset=keys).distinct()
    own = written(own, "pair-rows")
    several = own.groupBy("item").agg(F.count("*").alias("n")).where("n > 1").select(F.col("item").alias("twice"))
    marked = written(own.join(several, F.col("item").eqNullSafe(F.col("twice")), "left").select("item", *keys, F.col("twice").isNotNull().alias("many")), "pair-marks")

    def met(part: DataFrame) -> DataFrame:
        sizes = written(part.groupBy(*keys).agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("parts")).where("parts > 1"), "pair-cuts")
        cells = sizes.agg(F.coalesce(F.sum(F.col("parts").cast("long") * F.col("parts")), F.lit(0)).alias("n")).first().n
        n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cells), 20_000)
        parts = F.coalesce("parts", F.lit(1))
        dealt = part.join(bounded_broadcast(sizes), keys, "left").select("item", *keys, "many", F.pmod(F.xxhash64("item"), parts).cast("int").alias("at"), F.sequence(F.lit(0), parts - 1).alias("all"))
        left = dealt.select("item", *keys, F.col("many").alias("lm"), F.col("at").alias("i"), F.explode("all").alias("j"))
        right = dealt.select(F.col("item").alias("other"), *keys, F.col("many").alias("rm"), F.explode("all").alias("i"), F.col("at").alias("j"))
        by = [*keys, "i", "j"]
        # a stated number of partitions, which isn't made smaller by the few bytes that go in
        return left.repartition(n, *by).join(right.repartition(n, *by), by).select("item", "other", (F.col("lm") & F.col("rm")).alias("again"))

    twice = marked.where("many")
    once = met(marked).where("NOT again").select("item", "other")
    return once if twice.isEmpty() else once.unionByName(met(twice).select("item", "other").distinct())


def ir_metrics(retrieved: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """query_id, hit_rate, recall, precision, mrr, ndcg (4 places) of every question in expected.

    nDCG goes down the ranks; an item claims the first expected source that it matches and nothing above has claimed.
    """
    match = source_matches(retrieved, expected)
    n_exp = expected.groupBy("query_id").agg(F.countDistinct("exp_no").alias("n_exp"))
    n_ret = retrieved.groupBy("query_id").agg(F.countDistinct("rank").alias("n_ret"))
    per_rank = match.where(F.col("rank") <= k).groupBy("query_id", "rank").agg(F.array_sort(F.collect_set("exp_no")).alias("exps"))
    folded = per_rank.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "exps"))).alias("r"))
    zero = F.struct(F.array().cast("array<bigint>").alias("claimed"), F.lit(0.0).alias("dcg"))

    def step(a: Column, x: Column) -> Column:
        free = F.filter(x["exps"], lambda e: ~F.array_contains(a["claimed"], e))
        claim = F.struct(F.array_append(a["claimed"], F.element_at(free, 1)).alias("claimed"), (a["dcg"] + F.lit(1.0) / F.log2(x["rank"] + 1)).alias("dcg"))
        return F.when(F.size(free) > 0, claim).otherwise(a)

    gains = folded.select("query_id", F.aggregate("r", zero, step, lambda a: a["dcg"]).alias("dcg"))
    counts = match.groupBy("query_id").agg(F.countDistinct("exp_no").alias("exp_hit"), F.countDistinct("rank").alias("ret_hit"), F.min("rank").alias("first"))
    out = n_exp.join(n_ret, "query_id", "left").join(counts, "query_id", "left").join(gains, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_exp"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    zero_if = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return out.select(
        "query_id", F.when(F.col("exp_hit") > 0, 1.0).otherwise(0.0).alias("hit_rate"), zero_if(F.col("exp_hit") / F.col("n_exp")).alias("recall"), zero_if(F.col("ret_hit") / F.col("n_ret")).alias("precision"),
        zero_if(F.lit(1.0) / F.col("first")).alias("mrr"), zero_if(F.col("dcg") / ideal).alias("ndcg"), "n_exp", F.coalesce("n_ret", F.lit(0)).alias("n_ret"),
    )


def case_status(hit_rate: Column, recall: Column, n_exp: Column, n_ret: Column, answer: Column, error: Column) -> tuple[Column, Column]:
    """(status, failure category or null) by the first rule that holds."""
    refusal = T.is_refusal(answer)
    status = F.when(n_exp == 0, "not_run").when(error.isNotNull() | (hit_rate == 0) | refusal, "failed").when(recall >= 0.999, "passed").otherwise("partial")
    category = (
        F.when(n_exp == 0, F.lit(None).cast("string")).when(error.isNotNull(), "llm_failure").when((hit_rate == 0) & (n_ret > 0), "missing_source").when(hit_rate == 0, "retrieval_failure")
        .when(refusal, "prompt_issue").when(recall >= 0.999, F.lit(None).cast("string")).otherwise("poor_ranking")
    )
    return status, category


def average_metrics(cases: DataFrame, *by: Column | str, metrics: list[str] = METRICS) -> DataFrame:
    """Means of metrics at 4 places by groups, missing ones as 0; without groups an empty table has zeros."""
    aggs = [F.round(F.coalesce(F.avg(F.coalesce(m, F.lit(0.0))), F.lit(0.0)), 4).alias(m) for m in metrics]
    return cases.groupBy(*by).agg(*aggs)


def failure_histogram(cases: DataFrame) -> DataFrame:
    """category, n of every known category, zero included; unknown ones are left out."""
    spark = cases.sparkSession
    known = spark.createDataFrame([(c,) for c in FAILURES], "category string")
    seen = cases.select(F.explode("failures").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(known).join(seen, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def status_counts(cases: DataFrame) -> DataFrame:
    """passed, partial, failed, pass_rate."""
    n = lambda s: F.count_if(F.col("status") == s)
    return cases.agg(n("passed").alias("passed"), n("partial").alias("partial"), n("failed").alias("failed"), F.round(n("passed") / F.count("*"), 4).alias("pass_rate"))


def nearest_rank(column: str, percent: float) -> Column:
    """The value at rank ceil(p n)."""
    return F.expr(f"percentile_disc({percent}) WITHIN GROUP (ORDER BY {column})")


def upper_median(column: str) -> Column:
    """Of n sorted values that at position n // 2, from 0: by counts of distinct values, not by a list of them all.

    percentile_disc(0.5) is the lower one of two middle values; of the negated values it is the negated upper one.
    """
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{column})")


def labelled(labels: DataFrame, cases: DataFrame) -> DataFrame:
    """labels(case_id, label) with their cases(case_id, ...); labels without a case are dropped."""
    return labels.join(cases, "case_id")


def arm_summary(cases: DataFrame) -> DataFrame:
    """Per arm: pass rate (3 places), truncated median, 99th percentile, tokens, cost per question and per success."""
    n, passed, cost = F.count("*"), F.count_if("passed"), F.sum("cost")
    return cases.groupBy("arm").agg(
        F.round(passed / n, 3).alias("pass_rate"), F.expr("cast(percentile(latency_ms, 0.5) as bigint)").alias("p50_latency_ms"), nearest_rank("latency_ms", 0.99).cast("long").alias("p99_latency_ms"),
        F.sum("tokens").alias("tokens"), F.round(cost / n, 9).alias("cost_per_question"), F.round(cost / F.nullif(passed, F.lit(0)), 9).alias("cost_per_success"),
    )


def squad_summary(cases: DataFrame) -> DataFrame:
    """Per arm: counts, rate (4 places), nearest-rank percentiles of positive latencies, tokens and cost."""
    rows = cases.withColumn("lat", F.when(F.col("latency_ms") > 0, F.col("latency_ms")))
    n, passed = F.count("*"), F.count_if("passed")
    return rows.groupBy("arm").agg(
        n.alias("case_count"), passed.alias("passed"), F.round(passed / n, 4).alias("pass_rate"), F.coalesce(nearest_rank("lat", 0.5).cast("long"), F.lit(0)).alias("p50_latency_ms"),
        F.coalesce(nearest_rank("lat", 0.99).cast("long"), F.lit(0)).alias("p99_latency_ms"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("total_cost"),
    )


def verdict(single: Column, squad: Column) -> Column:
    """Whether the squad's pass rate earns its keep."""
    return F.when(squad > single + 0.05, "KEEP").otherwise("KILL")


def trajectory_summary(cases: DataFrame) -> DataFrame:
    """Rates, their gap, and upper medians and maxima of latency."""
    outcome, path = F.count_if("outcome_pass") / F.count("*"), F.count_if("trajectory_pass") / F.count("*")
    return cases.agg(
        F.count("*").alias("total_cases"), F.round(outcome, 4).alias("outcome_pass_rate"), F.round(path, 4).alias("trajectory_pass_rate"), F.round(outcome - path, 4).alias("gap"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms DESC)").alias("latency_p50"), F.max("latency_ms").alias("latency_max"),
    )


def regression_matrix(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per failure mode of either side: counts, trajectory failures, and whether it got worse, better, stayed or is new."""
    roll = lambda df, p: df.groupBy("mode").agg(F.count("*").alias(f"{p}_count"), F.count_if(~F.col("trajectory_pass")).alias(f"{p}_fails"))
    both = roll(before, "before").join(roll(after, "after"), "mode", "full_outer")
    out = both.withColumn("is_new", F.col("before_count").isNull()).fillna(0, ["before_count", "before_fails", "after_count", "after_fails"])
    return out.withColumns({"worsened": F.col("after_fails") > F.col("before_fails"), "improved": F.col("after_fails") < F.col("before_fails"), "unchanged": F.col("after_fails") == F.col("before_fails")})


def context_precision(judged: DataFrame) -> DataFrame:
    """query_id, context_precision of judged(query_id, rank, relevant): average precision; 0 without a relevant row, null with an unjudged one."""
    hits = F.sum(F.col("relevant").cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = judged.withColumn("gain", F.when(F.col("relevant"), hits / F.col("rank")).otherwise(0.0))
    total = F.sum(F.col("relevant").cast("int"))
    value = F.when(F.count_if(F.col("relevant").isNull()) > 0, F.lit(None).cast("double")).when(total == 0, F.lit(0.0)).otherwise(F.round(F.sum("gain") / total, 6))
    return rows.groupBy("query_id").agg(value.alias("context_precision"))


def judge_agreement(rows: DataFrame) -> DataFrame:
    """graded, agreed, agreement (4 places), ungraded, ungrounded of rows(human, judge, keyworded)."""
    graded = F.col("keyworded") & F.col("judge").isNotNull()
    agreed = F.count_if(graded & (F.col("human") == F.col("judge")))
    return rows.agg(
        F.count_if(graded).alias("graded"), agreed.alias("agreed"), F.round(agreed / F.nullif(F.count_if(graded), F.lit(0)), 4).alias("agreement"),
        F.count_if(F.col("keyworded") & F.col("judge").isNull()).alias("ungraded"), F.count_if(~F.col("keyworded")).alias("ungrounded"),
    )


def previous_run(runs: DataFrame, key: str, *order: Column) -> DataFrame:
    """Adds prev_score of the run before of the same key."""
    return runs.withColumn("prev_score", F.lag("score").over(Window.partitionBy(key).orderBy(*order)))


def case_scores(cases: DataFrame, recalls: DataFrame, violations: DataFrame) -> DataFrame:
    """query_id, retrieval_score, answer_score, combined_score, status of cases(query_id, keywords, verdict, answer).

    The answer score is a judge's verdict where there is one, else the share of keywords in the answer; a case passes if the
    mean of both scores is 1 and violations(query_id) doesn't name it.
    """
    bad = violations.distinct().withColumn("bad", F.lit(True))
    joined = cases.join(recalls, "query_id", "left").join(bad, "query_id", "left")
    by_words = F.round(T.keyword_share(F.coalesce("answer", F.lit("")), F.col("keywords")), 6)
    scored = joined.withColumns({"retrieval_score": F.coalesce("recall", F.lit(0.0)), "answer_score": F.when(F.col("verdict").isNotNull(), F.col("verdict").cast("double")).otherwise(by_words)})
    mean = (F.col("retrieval_score") + F.col("answer_score")) / 2
    return scored.select("query_id", "retrieval_score", "answer_score", F.round(mean, 6).alias("combined_score"), F.when((mean == 1) & F.col("bad").isNull(), "passed").otherwise("failed").alias("status"))
