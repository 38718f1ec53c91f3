"""Results of retrieval, kept by the question's key and the corpus' version.

The kept table has a folder for each version of the corpus. Questions whose key isn't in the folder of the current one are
the misses; they alone are computed, each distinct key once, and added. Folders of other versions are stale and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from granary.sources.tables import written


def cache_key(query: Column, strategy: str, kb: str | None = None) -> Column:
    """The key of a question under a strategy and a knowledge base; a null question is an empty one."""
    return F.sha2(F.concat_ws("|", F.coalesce(query, F.lit("")), F.lit(strategy), F.lit(kb or "")), 256)


def corpus_version(chunks: DataFrame) -> str:
    """A name for the contents of chunks, whatever the order of rows."""
    r = chunks.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*chunks.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}-{r.h or 0}"


def _folders(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cached(queries: DataFrame, compute, path: str, version: str, strategy: str, kb: str | None = None) -> DataFrame:
    """query_id, chunk_id, pos, score, rank of queries(query_id, query), from the table at path as far as it has them.

    compute(misses) gives these columns for misses(query_id, query), whose query_id is the key: one row for each distinct
    missing key. A question without results is kept too, as a row without a chunk, so it is no miss again. One writer at a time.
    """
    spark, folder = queries.sparkSession, f"version={version}"
    for other in _folders(spark, path):
        if other.startswith("version=") and other != folder:
            _drop(spark, f"{path}/{other}")
    keyed = queries.select("query_id", "query", cache_key(F.col("query"), strategy, kb).alias("cache_key"))
    distinct = keyed.groupBy("cache_key").agg(F.min(F.coalesce("query", F.lit(""))).alias("query"))
    at = f"{path}/{folder}"
    known = folder in _folders(spark, path)
    misses = distinct.join(spark.read.parquet(at).select("cache_key").distinct(), "cache_key", "left_anti") if known else distinct
    misses = written(misses.select(F.col("cache_key").alias("query_id"), "query"), "misses")
    if not misses.isEmpty() or not known:
        found = compute(misses).select(F.col("query_id").alias("cache_key"), "chunk_id", "pos", "score", "rank")
        misses.select(F.col("query_id").alias("cache_key")).join(found, "cache_key", "left").write.mode("append").parquet(at)
    kept = spark.read.parquet(at).where("chunk_id IS NOT NULL")
    return keyed.select("query_id", "cache_key").join(kept, "cache_key").select("query_id", "chunk_id", "pos", "score", "rank")
