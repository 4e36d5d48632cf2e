"""Differences between a listing and the stored entities, reconciliation by hash, and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.scalars import is_pseudo_hash
from loam.operators.find import in_scope
from loam.schema import MAX_FILE_BYTES


def snapshot_diff(stored: DataFrame, listed: DataFrame, scope: str | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``status, path``: new, deleted or changed (size, modification or hash differ, nulls alike)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where((F.col("size_bytes") <= max_bytes) & in_scope(F.col("path"), scope)).select("path", F.struct("size_bytes", "modified_at", "content_hash").alias(name))

    both = side(stored, "s").join(side(listed, "l"), "path", "full_outer")
    same = F.col("s.size_bytes").eqNullSafe(F.col("l.size_bytes")) & F.col("s.modified_at").eqNullSafe(F.col("l.modified_at")) & F.col("s.content_hash").eqNullSafe(F.col("l.content_hash"))
    status = F.when(F.col("s").isNull(), "new").when(F.col("l").isNull(), "deleted").when(~same, "changed")
    return both.select(status.alias("status"), "path").where(F.col("status").isNotNull())


def reconcile_by_hash(indexed: DataFrame, entities: DataFrame, scope: str | None = None) -> DataFrame:
    """``old, new``: indexed paths that are gone, where exactly one entity has their hash."""
    usable = entities.where(F.col("content_hash").isNotNull() & (F.col("lifecycle") != "dead"))
    lost = indexed.join(usable.select("path"), "path", "left_anti").select(F.col("path").alias("old"), "content_hash").distinct()
    one = usable.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("path").alias("new")).where(F.col("n") == 1)
    return lost.join(one, "content_hash").where(in_scope(F.col("new"), scope)).select("old", "new")


def rename_candidates(stored: DataFrame, listed: DataFrame, root: str | None = None) -> DataFrame:
    """``old, new``: missing, living entities whose hash exactly one unknown file of the listing has."""
    missing = stored.where((F.col("lifecycle") != "dead") & F.col("content_hash").isNotNull() & ~is_pseudo_hash(F.col("content_hash")) & in_scope(F.col("path"), root))
    missing = missing.join(listed.select("path"), "path", "left_anti").select(F.col("path").alias("old"), "content_hash")
    fresh = listed.where(F.col("content_hash").isNotNull()).join(stored.select("path"), "path", "left_anti")
    one = fresh.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("path").alias("new")).where(F.col("n") == 1)
    sole = missing.groupBy("content_hash").agg(F.count("*").alias("m"), F.min("old").alias("old")).where(F.col("m") == 1)
    return sole.join(one, "content_hash").select("old", "new")


def index_worklist(entities: DataFrame, vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """``path, needs_vector, needs_fts`` for entities that need either."""
    v = vectors.select("path", "content_hash", F.lit(True).alias("_v")).distinct()
    t = texts.select("path", F.lit(True).alias("_t")).distinct()
    both = entities.select("path", "content_hash").join(v, ["path", "content_hash"], "left").join(t, "path", "left")
    return both.select("path", F.col("_v").isNull().alias("needs_vector"), F.col("_t").isNull().alias("needs_fts")).where("needs_vector or needs_fts")


def health(entities: DataFrame, relations: DataFrame, vectors: DataFrame, listed: DataFrame) -> DataFrame:
    """One row of counts and a status: fail without entities, warn on differences or gaps, else ok."""
    d = snapshot_diff(entities, listed).agg(F.count("*").alias("n_diff"))
    e = entities.agg(F.count("*").alias("n_entities"), F.count_if(F.col("lifecycle") == "dead").alias("n_dead"))
    r = relations.agg(F.count("*").alias("n_relations"))
    v = vectors.agg(F.count("*").alias("n_vectors"))
    row = e.crossJoin(d).crossJoin(r).crossJoin(v)  # four tables of one row
    status = F.when(F.col("n_entities") == 0, "fail").when((F.col("n_diff") > 0) | (F.col("n_vectors") == 0), "warn").otherwise("ok")
    return row.withColumn("status", status)
