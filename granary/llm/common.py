"""Shared folders, written intermediate tables and word splitting for the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are maximal runs of characters other than these six ASCII white-space characters.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = re.compile(WORD_SEPARATORS)
#: str.translate table that lower-cases A-Z only.
ASCII_LOWER = {ord(c): c.lower() for c in _UPPER}
#: Rows of a table that may be broadcast; every caller counts the table before it broadcasts.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, a fresh temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = "file://" + base
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, folders: str | None = None) -> DataFrame:
    """Writes df as Parquet below the shared folder, in folders by a column if one is given, and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, partitionBy=folders)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path  # for drop_written
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        delete_path(t.sparkSession, t._granary_path)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else df for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def frequent(counted: DataFrame, key: str, n: str, most: int) -> Column:
    """A condition that holds for at most `most` rows of counted(key, n): those of the highest counts.

    Counts are taken in whole steps, each its own up to 100,000 and a 256th of a doubling beyond, so that a histogram of a
    bounded number of rows tells where to cut. Where the topmost step alone has too many rows, as many as fit are taken by
    the hash of the key.
    """
    fine, slices = 100_000, 1 << 16
    step = F.when(F.col(n) <= fine, F.col(n)).otherwise(F.floor(F.log2(F.col(n) / fine) * 256) + fine + 1).cast("long")
    sizes = sorted(((r.step, r["count"]) for r in counted.groupBy(step.alias("step")).count().collect()), reverse=True)  # some 110,000 rows at most
    least, kept = None, 0
    for s, size in sizes:
        if kept + size > most:
            break
        least, kept = s, kept + size
    if least is not None or not sizes:
        return step >= F.lit(0 if least is None else least)
    top, slice_ = sizes[0][0], F.pmod(F.xxhash64(key), F.lit(slices))
    within = sorted((r.slice, r["count"]) for r in counted.where(step == top).groupBy(slice_.alias("slice")).count().collect())
    upto = -1
    for s, size in within:
        if kept + size > most:
            break
        upto, kept = s, kept + size
    return (step == top) & (slice_ <= upto)


def filesystem(uri: str):
    """pyarrow file system and path of a URI; works on executors without a session."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, _UPPER, _UPPER.lower())


def words(text: str) -> list[str]:
    """The words of one text: runs of characters other than U+0020 and U+0009 to U+000D."""
    out = _SPLIT.split(text)
    if out and not out[0]:
        del out[0]
    if out and not out[-1]:
        del out[-1]
    return out


_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_ANY_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NO_TERM = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def term_pieces(text: bytes | None, size: int = 1 << 20):
    """The terms of one UTF-8 text, in lists: runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased. A
    text of over `size` bytes comes in pieces that are cut between terms, so a very long one needs no more memory; null has no terms."""
    text, at = text or b"", 0
    while len(text) - at > size:
        cut = _NO_TERM.search(text, at + size)
        end = cut.end() if cut else len(text)
        yield _TERM.findall(text[at:end].lower())
        at = end
    yield _TERM.findall(text[at:].lower() if at else text.lower())


def byte_texts(column) -> list:
    """The UTF-8 bytes of an Arrow string column, row by row."""
    import pyarrow as pa

    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def word_count(col):
    """Number of words of a text column as long; null counts 0. RE2 and Java read the class alike."""
    return F.when(col.isNull() | col.rlike(r"^[\x20\x09-\x0D]*$"), F.lit(0)).otherwise(
        F.size(F.split(F.regexp_replace(col, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), WORD_SEPARATORS))
    ).cast("long")


_SHIPPED: set[str] = set()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """To be called before Python code is sent out: caps the rows of an Arrow batch, so that a batch of very long texts
    stays within a worker's memory, and ships this package to the executors once for each application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))


def release() -> None:
    """Gives the free memory of a worker back to the system. To be called at the end of a task that held much: an idle
    worker keeps what it has freed, and the next stage's workers come on top of it. Without glibc only Arrow's is given back."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
