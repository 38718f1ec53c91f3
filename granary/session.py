"""Session settings that the operators' results rely on, and guards for broadcasts and for what Python workers hold."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that a side may have to be broadcast by name; beyond it Spark chooses.
BROADCAST_ROWS = 100_000
#: Rows and bytes of an Arrow batch at most, where texts go to Python workers; a row above that is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 256, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 21}


def configure(builder):
    """The settings of a SparkSession.Builder that oracles assume."""
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df hinted for broadcast if it has at most limit rows; the count stops at limit + 1."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, what is run sends batches within BATCH to Python workers, so what they hold doesn't grow with the table."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_batches_small() -> None:
    """As small_batches(), but from here on in the active session: for columns of Arrow functions, which run when their caller likes."""
    spark = SparkSession.active()
    for k, v in BATCH.items():
        spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts. One that is a single file below a core's share of splits is dealt over all cores, as a file
    of one row group is read by one task; larger tables and folders are read as they are."""
    df = table(spark, sf_dir, name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if status.isFile() and 1 << 22 < status.getLen() < cores << 27 else df
