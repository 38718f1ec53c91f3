"""Event streams into a table keyed by (trace, seq), in order and each event once, with an end mark for every finished trace.

A micro-batch is written as a folder of its own name, replaced if the batch is done again after a failure, and leaves out
the keys that other batches have written, so a stream that starts anew from its source adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: What follows the last event of a trace.
END = "[DONE]"
KEYS = ["trace", "seq"]


class Progress(StreamingQueryListener):
    """Rows and batches that the streams of a session have read, by the stream's name."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: set[str] = set()
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows
        self.batches[name] = max(self.batches.get(name, 0), event.progress.batchId + 1)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(self._names.get(str(event.runId), str(event.id)))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Writes a micro-batch of events(trace, seq, type, data, last) to path/batch=<batch>, each key once; of rows that repeat a key within the batch, the least."""
    spark = rows.sparkSession
    own = rows.groupBy(*KEYS).agg(F.min(F.struct("type", "data", "last")).alias("e")).select(*KEYS, "e.*")
    if _exists(spark, path):
        before = spark.read.schema(f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(path).where(F.col("batch") != batch).select(*KEYS)
        own = own.join(before, KEYS, "left_anti")
    own.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def deliver(stream: DataFrame, path: str, checkpoint: str, name: str | None = None):
    """Runs a stream of events(trace, seq, type, data, last) over all that is there into the table at path; last marks a trace's last event. The finished query."""
    writer = stream.select("trace", "seq", "type", "data", "last").writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path))
    query = (writer.queryName(name) if name else writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def delivered(spark: SparkSession, path: str, schema: str = "trace long, seq long, type string, data string, last boolean") -> DataFrame:
    """trace, seq, type, data of the table at path, with a row of type END after the last event of every finished trace. Order by trace and seq for a client's view."""
    events = spark.read.schema(f"{schema}, batch long").parquet(path)
    ends = events.where("last").groupBy("trace").agg((F.max("seq") + 1).alias("seq")).select("trace", "seq", F.lit(END).alias("type"), F.lit(None).cast("string").alias("data"))
    return events.select("trace", "seq", "type", "data").unionByName(ends)


def server_sent(rows: DataFrame) -> DataFrame:
    """trace, lines: the server-sent lines of delivered rows, a trace's in the order of seq; the end mark is a line of its own. A trace's lines are one client's answer."""
    line = F.when(F.col("type") == END, F.lit(f"data: {END}")).otherwise(F.concat(F.lit("data: "), F.to_json(F.struct("type", "seq", "data"))))
    return rows.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l")).select("trace", F.transform("l", lambda x: x["line"]).alias("lines"))
