"""Records of uploads, versions, histories, memories, label sessions and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from granary.functions import text as T
from granary.operators.storage import replace_by_key


def uploaded(files: DataFrame, kind: Column) -> tuple[DataFrame, DataFrame]:
    """Of files(document_id, name, content) that are accepted (kind isn't null): their first version and the history of it."""
    taken = files.withColumn("kind", kind).where(F.col("kind").isNotNull())
    versions = taken.select("document_id", "kind", F.lit(1).cast("long").alias("version"), F.octet_length("content").cast("long").alias("size"))
    return versions, taken.select("document_id", F.lit(1).cast("long").alias("version"), F.lit("uploaded").alias("action"))


def reprocessed(chunks: DataFrame, versions: DataFrame, new_chunks: DataFrame, action: str = "reprocess") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, versions, history) after the documents of new_chunks(document_id, ...) were made anew.

    Their old chunks go, each gets the version after its last one, and its history two events: begun and completed. The
    action names why: reprocess, rechunk or reindex do the same.
    """
    ids = new_chunks.select("document_id").distinct()
    last = versions.join(ids, "document_id", "right").groupBy("document_id").agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"))
    added = last.select("document_id", (F.col("v") + 1).alias("version"))
    events = added.select("document_id", "version", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit(f"{action}.started").alias("event")), F.struct(F.lit(2).alias("seq"), F.lit(f"{action}.completed").alias("event")))).alias("e")).select("document_id", "version", "e.seq", "e.event")
    return replace_by_key(chunks, new_chunks, "document_id"), versions.select("document_id", "version").unionByName(added), events


def reindexed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks(chunk_id, embedding, ...) with the vectors(chunk_id, embedding) in place of theirs if there is just one for each chunk, else as they were.

    The check is a column of one row, so nothing is decided on the driver.
    """
    both = chunks.select("chunk_id").join(vectors.groupBy("chunk_id").agg(F.count("*").alias("n")), "chunk_id", "full")
    whole = both.agg(F.every(F.coalesce(F.col("n") == 1, F.lit(False))).alias("whole")).crossJoin(
        chunks.agg(F.count("*").alias("a")).crossJoin(vectors.agg(F.count("*").alias("b")))
    ).select((F.col("whole") & (F.col("a") == F.col("b"))).alias("whole"))  # one row
    new = vectors.groupBy("chunk_id").agg(F.first("embedding").alias("new"))
    joined = chunks.join(new, "chunk_id", "left").crossJoin(F.broadcast(whole))
    return joined.withColumn("embedding", F.when(F.col("whole"), F.col("new")).otherwise(F.col("embedding"))).drop("new", "whole")


def remembered(pairs: DataFrame) -> DataFrame:
    """Memory rows id, query, answer, embedding of pairs that have a vector; append them to a JSON lines table."""
    return pairs.where(F.size("embedding") > 0).select("id", "query", "answer", "embedding")


def memory_list(memories: DataFrame) -> DataFrame:
    """Memories without their vectors."""
    return memories.drop("embedding")


def source_of_chunk(chunks: DataFrame) -> DataFrame:
    """What an answer's source list shows of a chunk."""
    return chunks.select("chunk_id", "document_id", "document_name", "page", "section", "content")


def knowledge_base_response(bases: DataFrame) -> DataFrame:
    """Rows of bases(kb, documents, tokens) under the names that callers get, with the values that never change."""
    return bases.select(F.col("kb").alias("id"), F.col("kb").alias("name"), F.col("documents").alias("documentCount"), F.col("tokens").alias("tokenCount"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("description"))


def redacted(value: Column, kind: DataType) -> Column:
    """A value of any type with malicious phrases replaced in all its strings, however deep; keys and other values stay."""
    if isinstance(kind, StringType):
        return T.redact(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: redacted(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(redacted(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def label_sessions(reports: DataFrame, saved: DataFrame) -> DataFrame:
    """key, source_report, conflict, conflict_report, labels: per key the latest of reports(key, path, created_at) and the labels
    of saved(key, source_report, labels), which count only if they were made for that report."""
    last = reports.groupBy("key").agg(F.max(F.struct("created_at", "path")).alias("r")).select("key", F.col("r.path").alias("source_report"))
    joined = last.join(saved.select("key", F.col("source_report").alias("of"), F.col("labels").alias("l")), "key", "left")
    conflict = F.coalesce(F.col("of") != F.col("source_report"), F.lit(False))
    return joined.select("key", "source_report", conflict.alias("conflict"), F.when(conflict, F.col("of")).alias("conflict_report"), F.when(~conflict, F.coalesce("l", F.lit(0))).otherwise(F.lit(0)).alias("labels"))


def progress_events(cases: DataFrame) -> DataFrame:
    """run, seq, event, case_id of runs' cases(run, case_id): started, each case's start and end in order, completed, DONE.

    An event's number follows from its case's place, so only cases are counted within a run.
    """
    place = F.row_number().over(Window.partitionBy("run").orderBy("case_id")).cast("long")
    numbered = cases.select("run", "case_id", place.alias("i"))
    inner = numbered.select("run", F.explode(F.array(F.struct((F.col("i") * 2).alias("seq"), F.lit("case.started").alias("event")), F.struct((F.col("i") * 2 + 1).alias("seq"), F.lit("case.completed").alias("event")))).alias("e"), "case_id")
    ends = numbered.groupBy("run").agg(F.max("i").alias("n"))
    none = F.lit(None).cast(cases.schema["case_id"].dataType)
    outer = ends.select("run", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("seq"), F.lit("started").alias("event")), F.struct((F.col("n") * 2 + 2).alias("seq"), F.lit("completed").alias("event")), F.struct((F.col("n") * 2 + 3).alias("seq"), F.lit("DONE").alias("event")))).alias("e"), none.alias("case_id"))
    return inner.unionByName(outer).select("run", "e.seq", "e.event", "case_id")


def retry_after(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """request_id, retry_after of requests(request_id, client, ts): seconds until the client's oldest request of the window leaves it."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = Window.partitionBy("client").orderBy("t").rangeBetween(-seconds * 1_000_000 + 1, 0)
    timed = requests.select("request_id", "client", at.alias("t"))
    age = (F.col("t") - F.min("t").over(span)) / F.lit(1_000_000)
    return timed.select("request_id", F.greatest(F.lit(0), F.floor(F.lit(seconds) - age)).cast("long").alias("retry_after"))


def retry_plan(responses: DataFrame, attempts: int = 3, base: float = 1.0, cap: float = 30.0) -> DataFrame:
    """Adds retried and delay to responses(status, attempt): 429 and 503 are tried again after a doubling, capped delay until attempts are used up."""
    again = F.col("status").isin(429, 503) & (F.col("attempt") < attempts)
    return responses.withColumns({"retried": again, "delay": F.when(again, F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 1)))})


def rounded_metric(column: Column) -> Column:
    """A metric at four places."""
    return F.round(column, 4)


def openapi_paths(content: Column) -> Column:
    """Array of the path templates below `paths:` of an OpenAPI document in YAML: the lines one level in that begin with a slash."""
    block = F.regexp_extract(F.concat(F.lit("\n"), content, F.lit("\n")), r"(?s)\npaths:[ \t]*\n((?:[ \t#][^\n]*\n|\n)*)", 1)
    level = F.regexp_extract(block, r"(?m)^([ \t]+)[\"']?/", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: (level != "") & F.startswith(x, level) & F.regexp_like(F.substring(x, F.length(level) + 1, F.lit(1 << 20)), F.lit(r"^[\"']?/[^:]*[\"']?:")))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"^[ \t]+[\"']?(/[^:\"']*)", 1))
