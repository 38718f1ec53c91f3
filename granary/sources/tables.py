"""Written tables in the shared folder: lineage ends there, so a lost executor costs nothing, and later steps read them as often as they like."""

from __future__ import annotations

from pyspark.sql import DataFrame

from granary.sources.files import shared_path


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """df as Parquet at a new shared path, read back; in row groups of some group_bytes, if given."""
    path = shared_path(df.sparkSession, name)
    (df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
