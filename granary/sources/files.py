"""Text, JSON, JSONL and CSV files as DataFrames, and the small fixture files that tests and queries read."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from granary.functions import text as T
from granary.session import bounded_broadcast, keep_batches_small, small_batches

#: Files read as text; others are refused or read leniently.
TEXT_ENDINGS = r"\.(txt|md)$"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that driver and executors share: below spark.checkpoint.dir, or, in local mode alone, below a temporary folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/granary/{uuid.uuid4().hex}/{name}"


def put_text(spark: SparkSession, name: str, text: str) -> str:
    """Writes a small text to a new shared path, through Hadoop's file system."""
    path = shared_path(spark, name)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return path


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, content: whole files as UTF-8; bytes that aren't are replaced."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def document_type(name, strict: bool = True):
    """How a file is read by its name: pdf, text, or null for what the strict reader refuses."""
    lower = F.lower(name)
    rest = F.lit(None).cast("string") if strict else F.lit("text")
    return F.when(lower.endswith(".pdf"), "pdf").when(lower.rlike(TEXT_ENDINGS), "text").otherwise(rest)


def read_pages(spark: SparkSession, path: str, extract, suffix: str = "*") -> DataFrame:
    """path, pages (array of cleaned page texts, null for a page without text), content (pages joined by line ends) of the files below a path.

    extract(bytes) gives a file's page texts, with None for a page without text; any PDF library's reader will do, and
    none is needed here. A file is read whole by one task, and a worker has one at a time unless they are small.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            pages = [list(extract(x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pages, pa.list_(pa.string()))], names=["path", "raw"])

    keep_batches_small()
    cleaned = _bytes_below(spark, path, suffix).select("path", "content").mapInArrow(run, "path string, raw array<string>").select("path", F.transform("raw", T.clean_page).alias("pages"))
    return cleaned.select("path", "pages", F.array_join("pages", "\n", "").alias("content"))


def _bytes_below(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)


#: Bytes of a volume at most; a longer page is a volume of its own.
VOLUME_BYTES = 1 << 22


def write_volumes(pages: DataFrame, path: str, order: str) -> None:
    """The pages (part: a whole number, page: text, and a column that orders a part's pages) as text files of VOLUME_BYTES at most.

    A line end follows each page. A part is as many volumes as its length asks for, in folders part=/volume=/pages= that
    give their order and what they hold; tasks take ranges of the order, so neither a file nor a task grows with its part.
    """
    most = VOLUME_BYTES

    def bind(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def volume():
            text = pa.array([b"\n".join(held)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([number], pa.int64()), pa.array([len(held)], pa.int64()), text], names=["part", "volume", "pages", "value"])

        number, of, held, size = TaskContext.get().partitionId() << 32, None, [], 0
        for b in batches:
            for part, page in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if held and (part != of or size + len(page) + 1 > most):
                    yield volume()
                    number, held, size = number + 1, [], 0
                of, size = part, size + len(page) + 1
                held.append(page)
        if held:
            yield volume()

    schema = StructType([*(StructField(c, LongType()) for c in ("part", "volume", "pages")), StructField("value", StringType())])
    ranges = pages.repartitionByRange("part", order).sortWithinPartitions("part", order).select(F.col("part").cast("long"), "page")
    with small_batches(pages.sparkSession):
        ranges.mapInArrow(bind, schema).write.partitionBy("part", "volume", "pages").text(path)


def read_volumes(spark: SparkSession, path: str, extract) -> DataFrame:
    """part, page_no (from 0 in the part), page of what write_volumes() wrote, cut by a page extractor as in read_pages()."""
    named = [F.regexp_extract("path", r"/part=([^/]*)/volume=([^/]*)/pages=([^/]*)/[^/]*$", i + 1).try_cast("long").alias(c) for i, c in enumerate(("part", "volume", "pages"))]
    listed = _bytes_below(spark, path, "*.txt").select("path", *named)
    before = F.sum("pages").over(Window.partitionBy("part").orderBy("volume").rowsBetween(Window.unboundedPreceding, -1))
    starts = listed.select("path", "part", F.coalesce(before, F.lit(0)).alias("start"))
    rows = read_pages(spark, path, extract, "*.txt").join(bounded_broadcast(starts), "path").select("part", "start", F.posexplode("pages").alias("at", "page"))
    return rows.select("part", (F.col("start") + F.col("at")).alias("page_no"), "page")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds rows to a JSON lines table; the commit protocol shows all of them or none."""
    df.write.mode("append").json(path)


def migrate_json(spark: SparkSession, path: str, target: str, schema: str) -> DataFrame:
    """Writes a file with one JSON array as JSON lines, keeps the old file beside it as .bak, and reads the lines."""
    read_json_table(spark, path, schema).write.json(target)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, jvm.org.apache.hadoop.fs.Path(path + ".bak"))
    return read_jsonl(spark, target, schema)


def put_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file so that readers see the old text or the new one, never a part and never nothing: a fresh file is
    renamed over it in one step, by the operating system for local paths and else by the file system's own overwriting rename."""
    jvm = spark.sparkContext._jvm
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    at = jvm.org.apache.hadoop.fs.Path(fresh)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        here, there = (jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in (path, fresh))
        Path(there).parent.mkdir(parents=True, exist_ok=True)
        Path(there).write_text(text, encoding="utf-8")
        Path(here).with_name(f".{Path(here).name}.crc").unlink(missing_ok=True)  # the old text's; without one readers don't check
        os.replace(there, here)
        return
    out = fs.create(at)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.java.lang.Enum.valueOf(rename, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at, jvm.org.apache.hadoop.fs.Path(path), over)


def write_pair(spark: SparkSession, folder: str, baseline: str, improved: str) -> None:
    """Names the two reports of the last pair of runs."""
    put_atomic(spark, f"{folder}/latest_pair.json", json.dumps({"baseline": baseline, "improved": improved}))


def read_pair(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """role and the columns of the reports that the pointer names; None if it or one of them can't be read, so that the caller falls back."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/latest_pair.json")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    named = spark.read.schema("baseline string, improved string").json(f"{folder}/latest_pair.json").first()
    out = None
    for role in ("baseline", "improved"):
        name = named and named[role]
        if not name:
            continue
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")):
            return None
        part = spark.read.schema(schema).json(f"{folder}/{name}", mode="DROPMALFORMED").select(F.lit(role).alias("role"), "*")
        if part.isEmpty():
            return None
        out = part if out is None else out.unionByName(part)
    return out


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with one JSON array; a broken file is empty."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a head; None and empty fields are null."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="None")


def byte_slice(content, start: int, length: int):
    """Bytes from a 0-based offset."""
    return F.substring(content, start + 1, length)


#: Bytes of a range that names no end.
WINDOW_BYTES = 1 << 20


def byte_window(content, header):
    """Struct of status, start, last, size and part: the bytes that a header `bytes=first-last` asks for.

    A missing first is 0; a missing last is that of a window of WINDOW_BYTES, or of the content. 206 with the part; 416
    without one where first or last is beyond the content or first is after last; 200 with the whole content for a null or
    empty header; 400 for any other header. Null content gives nulls but for the header's own status 400.
    """
    size = F.octet_length(content).cast("long")
    number = lambda i: F.regexp_extract(header, r"^(?:bytes=)?([0-9]{0,18})-([0-9]{0,18})$", i).try_cast("long")
    first = F.coalesce(number(1), F.lit(0).cast("long"))
    last = F.coalesce(number(2), F.least(first + WINDOW_BYTES - 1, size - 1))
    whole, formed = header.isNull() | (header == ""), header.rlike(r"^(?:bytes=)?[0-9]{0,18}-[0-9]{0,18}$")
    status = F.when(whole, F.when(size.isNotNull(), 200)).when(~formed, 400).when((first >= size) | (last >= size) | (first > last), 416).when(size.isNotNull(), 206)
    inside = status == 206
    part = F.when(status == 200, content).when(inside, F.substring(content, (first + 1).cast("int"), (last - first + 1).cast("int")))
    return F.struct(status.alias("status"), F.when(inside, first).alias("start"), F.when(inside, last).alias("last"), size.alias("size"), part.alias("part"))


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Replaces a Parquet table, or with `by` only the partitions that df has."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
