"""Exact duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.scalars import is_pseudo_hash
from loam.operators.find import in_scope
from loam.session import cut


def duplicate_members(entities: DataFrame, scope: str | None = None) -> DataFrame:
    """``content_hash, n, path``: one row a member, so a hot hash is no single row."""
    rows = entities.where(F.col("content_hash").isNotNull() & ~is_pseudo_hash(F.col("content_hash")) & in_scope(F.col("path"), scope)).select("content_hash", "path")
    sizes = rows.groupBy("content_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return rows.join(sizes, "content_hash").select("content_hash", "n", "path")


def duplicate_groups(entities: DataFrame, scope: str | None = None) -> DataFrame:
    """``content_hash, n, paths``: the largest groups first; paths in order."""
    rows = entities.where(F.col("content_hash").isNotNull() & ~is_pseudo_hash(F.col("content_hash")) & in_scope(F.col("path"), scope))
    groups = rows.groupBy("content_hash").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))
    return groups.where(F.col("n") > 1).orderBy(F.col("n").desc(), "content_hash")


def duplicate_page(entities: DataFrame, scope: str | None = None, limit: int = 50, offset: int = 0, members: int = 100) -> DataFrame:
    """``content_hash, n, paths``: a page of groups, the largest first, with the first ``members`` paths of each.

    The page's hashes are few; their paths are cut to the first ones before they are dealt by hash, so
    a hash that many files share is no large row.
    """
    rows = entities.where(F.col("content_hash").isNotNull() & ~is_pseudo_hash(F.col("content_hash")) & in_scope(F.col("path"), scope)).select("content_hash", "path")
    sizes = rows.groupBy("content_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1).orderBy(F.col("n").desc(), "content_hash").offset(offset).limit(limit)
    page = cut(sizes)
    nth = F.row_number().over(Window.partitionBy("content_hash").orderBy("path"))
    first = rows.join(F.broadcast(page), "content_hash").withColumn("nth", nth).where(F.col("nth") <= members)
    groups = first.groupBy("content_hash", "n").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return groups.orderBy(F.col("n").desc(), "content_hash")


def hash_paths(entities: DataFrame) -> DataFrame:
    """The multimap from hash to paths, with its size."""
    return entities.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
