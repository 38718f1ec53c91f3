"""Changes of immutable tables: merge, upsert, replace, delete, versions, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge_update(base: DataFrame, updates: DataFrame, key: str, *columns: str) -> DataFrame:
    """base with columns replaced by the updates' values where there are any."""
    new = updates.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    out = base.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*(f"new_{c}" for c in columns))


def replace_by_key(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of base whose key isn't in new, and new."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key over both tables."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return base.unionByName(changes).withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def delete_by_key(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Adds is_latest: whether a row is the first of its key in the given order."""
    return rows.withColumn("is_latest", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def page_of(rows: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """One page, from 1, of at most size (1 to 100) rows. A page is small, so the sort keeps only rows up to its end."""
    size = max(1, min(size, 100))
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)
