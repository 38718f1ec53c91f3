"""Streams: state that expires, and events that are delivered in order and once."""

import random

from pyspark.sql import functions as F

from granary.streaming import delivery as D, stateful as SS

REQUESTS = "request_id long, client long, ts timestamp"


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, client long, t long").select("request_id", "client", F.timestamp_seconds("t").alias("ts"))


def test_limiter_in_several_runs_equals_the_batch_and_idle_clients_leave_no_state(spark, tmp_path):
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(300):
        at += rng.randint(0, 40)
        rows.append((i, i % 4 if i < 150 else 7, at))  # clients 0 to 3 fall silent halfway
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for lo in range(0, 300, 75):
        requests(spark, rows[lo : lo + 75]).coalesce(1).write.mode("append").parquet(source)
        SS.run_available(SS.rate_limit_stream(spark.readStream.schema(REQUESTS).parquet(source), 3, 120, "10 seconds"), out, mark)
    got = {r.request_id: r.admitted for r in spark.read.parquet(out).collect()}
    assert got == {r.request_id: r.admitted for r in SS.rate_limit(requests(spark, rows), 3, 120).collect()} and not all(got.values())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SS.STATE_STORE)
    try:
        kept = spark.read.format("statestore").option("path", mark).option("stateVarName", "admitted").load()
        clients = {r.c for r in kept.select(F.col("key.client").alias("c")).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert clients == {7}


def event(trace, seq, last=False):
    return (trace, seq, "token", f"{trace}/{seq}", last)


def test_each_event_once_after_a_restart_and_from_the_start(spark, tmp_path):
    schema = "trace long, seq long, type string, data string, last boolean"
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    progress = D.Progress()
    spark.streams.addListener(progress)
    try:
        events = [event(t, s, s == 9) for t in range(5) for s in range(10)]
        random.Random(1).shuffle(events)
        read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        for lo in (0, 20):
            spark.createDataFrame([*events[lo : lo + 20], events[lo]], schema).coalesce(1).write.mode("append").parquet(source)  # one event is sent twice
            D.deliver(read(), out, mark, "events")
        half = D.delivered(spark, out)
        assert half.where(F.col("type") != D.END).count() == 40
        spark.createDataFrame(events[40:], schema).coalesce(1).write.mode("append").parquet(source)
        D.deliver(read(), out, mark, "events")  # goes on from the checkpoint
        D.deliver(read(), out, mark + "-new", "again")  # starts anew, and so sees all events again
    finally:
        import time

        for _ in range(100):
            if progress.rows.get("again", 0) >= 52:
                break
            time.sleep(0.1)
        spark.streams.removeListener(progress)
    got = sorted((r.trace, r.seq, r.type) for r in D.delivered(spark, out).collect())
    assert got == sorted([(t, s, "token") for t in range(5) for s in range(10)] + [(t, 10, D.END) for t in range(5)])
    assert progress.rows == {"events": 52, "again": 52} and progress.batches["again"] == 3
    lines = {r.trace: r.lines for r in D.server_sent(D.delivered(spark, out)).collect()}
    assert all(len(v) == 11 and v[-1] == "data: [DONE]" and [f'"seq":{i},' in x for i, x in enumerate(v[:-1])] == [True] * 10 for v in lines.values())


def test_a_batch_done_again_replaces_itself(spark, tmp_path):
    schema = "trace long, seq long, type string, data string, last boolean"
    out = str(tmp_path / "out")
    for batch, seqs in ((0, [0, 1]), (1, [1, 2]), (1, [1, 2, 3])):
        D.write_batch(spark.createDataFrame([event(1, s) for s in seqs], schema), batch, out)
    rows = spark.read.parquet(out).select("seq", "batch").collect()
    assert sorted((r.seq, r.batch) for r in rows) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert D.delivered(spark, out).count() == 4  # without a last event there is no end mark
