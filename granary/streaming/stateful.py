"""Stateful operators over streams and their batch forms."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, StructField, StructType


def rate_limit(requests: DataFrame, limit: int, seconds: float = 60) -> DataFrame:
    """request_id, client, admitted of requests(request_id, client, ts) under a sliding window; denied ones don't count later.

    A request is denied if `limit` admitted ones lie within the last `seconds`; one without a time is denied only if the
    limit is 0. A client's requests are read in the order of time and request_id; a task holds the times of at most
    `limit` of them, however many there are. A null client is a client of its own.
    """
    timed = requests.select("request_id", "client", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    out = StructType([*timed.schema.fields[:2], StructField("admitted", BooleanType())])

    def decide(batches):
        import pyarrow as pa

        client, kept = None, deque()
        for b in batches:
            ok = []
            for c, t in zip(b.column("client").to_pylist(), b.column("t").to_pylist(), strict=True):
                if c != client:
                    client = c
                    kept.clear()
                while t is not None and kept and kept[0] <= t - seconds:
                    kept.popleft()
                ok.append(limit > 0 if t is None else len(kept) < limit)
                if ok[-1] and t is not None:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([b.column("request_id"), b.column("client"), pa.array(ok, pa.bool_())], names=out.names)

    return timed.repartition("client").sortWithinPartitions("client", "t", "request_id").mapInArrow(decide, out)


#: The state store that list state and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admissions(StatefulProcessor):
    """A client's state: the times of its admitted requests within the window, at most `limit`; a timer ends it when the last of them has left the window."""

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "t double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        kept = deque(t for (t,) in self.admitted.get())
        own = pd.concat(list(rows)).sort_values(["t", "request_id"], na_position="first")
        ok = []
        for t in own.t:
            none = pd.isna(t)
            while not none and kept and kept[0] <= t - self.seconds:
                kept.popleft()
            ok.append(self.limit > 0 if none else len(kept) < self.limit)
            if ok[-1] and not none:
                kept.append(t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.admitted.put([(float(t),) for t in kept])
            self.handle.registerTimer(int((kept[-1] + self.seconds) * 1000) + 1)
        else:
            self.admitted.clear()
        yield pd.DataFrame({"request_id": own.request_id, "client": key[0], "admitted": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.admitted.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int, seconds: float = 60, late: str = "1 hour") -> DataFrame:
    """The streaming form of rate_limit, of requests whose ts is a timestamp; those later than `late` behind the newest are dropped.

    State expires: when the watermark has passed a client's window, nothing is kept of it. Needs the state store
    STATE_STORE; run_available() starts streams with it.
    """
    timed = requests.withWatermark("ts", late).select("request_id", "client", "ts", (F.unix_micros("ts") / 1e6).alias("t"))
    out = StructType([*(requests.schema[c] for c in ("request_id", "client")), StructField("admitted", BooleanType())])
    return timed.groupBy("client").transformWithStateInPandas(Admissions(limit, seconds), out, "append", "eventTime")


def event_counts(events: DataFrame, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """stage, window_start, n of events(ts, stage), a batch or a stream, which is held open for late events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = timed.withWatermark("ts", late) if events.isStreaming else timed
    return rows.groupBy(F.window("ts", window).alias("w"), "stage").agg(F.count("*").alias("n")).select("stage", F.col("w.start").alias("window_start"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there into a Parquet table, with the state store that timers need; the session's own setting is put back."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STATE_STORE)
    try:
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def fold_steps(events: DataFrame) -> DataFrame:
    """run, step, reason, tool, latency_ms, observation of agent events(run, step, type, data)."""
    of = lambda kind: F.max(F.when(F.col("type") == kind, F.col("data")))
    return events.groupBy("run", "step").agg(of("reason").alias("reason"), of("action.start").alias("tool"), of("action.done").cast("long").alias("latency_ms"), of("observation").alias("observation")).where("tool IS NOT NULL")


def client_id(forwarded: Column, peer: Column) -> Column:
    """The first address of a forwarding header, else the peer."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer)


def sse_content(lines: Column) -> Column:
    """The content of an ordered array of server-sent lines up to [DONE]: deltas put together; other lines are skipped."""
    payloads = F.transform(F.filter(F.transform(lines, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s.startswith("data: ")), lambda s: F.substring(s, 7, 1 << 30))
    end = F.array_position(payloads, "[DONE]").cast("int")
    open_ = F.when(end > 0, F.slice(payloads, 1, F.greatest(end - 1, F.lit(0)))).otherwise(payloads)
    return F.array_join(F.transform(open_, lambda p: F.coalesce(F.get_json_object(p, "$.choices[0].delta.content"), F.lit(""))), "")
