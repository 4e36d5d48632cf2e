"""Table maintenance: every mutation is a function from tables to new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.scalars import basename, extension
from loam.schema import ENTITY_COLUMNS, HISTORY
from loam.session import cut

UPDATED = ["name", "extension", "size_bytes", "modified_at", "accessed_at", "lifecycle", "content_hash", "git_author"]
KEPT = ["id", "created_at", "summary"]


def _joined(old: DataFrame, new: DataFrame) -> DataFrame:
    a = old.select("path", F.struct(*[c for c in ENTITY_COLUMNS if c != "path"]).alias("o"))
    b = new.select("path", F.struct(*[c for c in ENTITY_COLUMNS if c != "path"]).alias("n"))
    return a.join(b, "path", "full_outer")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities after ``new`` (one row a path) came in: id, created_at and summary of a known path stay."""
    cols = {"path": F.col("path")}
    for c in UPDATED:
        cols[c] = F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    for c in KEPT:
        cols[c] = F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return _joined(old, new).select(*[cols[c].alias(c) for c in ENTITY_COLUMNS])


def upsert_history(old: DataFrame, new: DataFrame, at: int) -> DataFrame:
    """History rows of the same upsert: created, or lifecycle and then modified."""
    both = _joined(old, new).where(F.col("n").isNotNull())
    known = F.col("o").isNotNull()
    none = F.lit(None).cast("string")

    def event(name: str, before, after, seq: int):
        return F.struct(F.lit(name).alias("event"), before.alias("old_lifecycle"), after.alias("new_lifecycle"), F.lit(seq).alias("seq"))

    moved = known & ~F.col("o.lifecycle").eqNullSafe(F.col("n.lifecycle"))
    edited = known & F.col("n.content_hash").isNotNull() & ~F.col("n.content_hash").eqNullSafe(F.col("o.content_hash"))
    events = F.array(
        F.when(~known, event("created", none, F.col("n.lifecycle"), 0)),
        F.when(moved, event("lifecycle", F.col("o.lifecycle"), F.col("n.lifecycle"), 0)),
        F.when(edited, event("modified", none, none, 1)),
    )
    rows = both.select(F.coalesce("o.id", "n.id").alias("entity_id"), "path", F.col("n.size_bytes").alias("size_bytes"), F.col("n.content_hash").alias("content_hash"), F.explode(F.array_compact(events)).alias("e"))
    return rows.select("entity_id", "path", "e.event", "e.old_lifecycle", "e.new_lifecycle", none.alias("old_path"), "size_bytes", "content_hash", F.lit(at).cast("long").alias("recorded_at"), "e.seq")


def delete(entities: DataFrame, relations: DataFrame, history: DataFrame, gone: DataFrame, at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the paths of ``gone``: rows and edges at either end go, existing rows leave a deleted event."""
    gone = gone.select("path").distinct()
    left = entities.join(gone, "path", "left_anti").select(*ENTITY_COLUMNS)
    edges = without_edges(relations, gone)
    events = entities.join(gone, "path", "left_semi").select(
        F.col("id").alias("entity_id"), "path", F.lit("deleted").alias("event"), F.col("lifecycle").alias("old_lifecycle"), F.lit(None).cast("string").alias("new_lifecycle"),
        F.lit(None).cast("string").alias("old_path"), "size_bytes", "content_hash", F.lit(at).cast("long").alias("recorded_at"), F.lit(0).alias("seq"),
    )
    return left, edges, history.unionByName(events)


def without_edges(relations: DataFrame, gone: DataFrame) -> DataFrame:
    keep = relations.join(gone.select(F.col("path").alias("from_path")), "from_path", "left_anti")
    return keep.join(gone.select(F.col("path").alias("to_path")), "to_path", "left_anti").select(*relations.columns)


def dead(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("lifecycle") == "dead")


def touch(entities: DataFrame, accesses: DataFrame) -> DataFrame:
    """``accesses(path, ts)``: the last access only moves forward."""
    last = accesses.groupBy("path").agg(F.max("ts").alias("_ts"))
    return entities.join(last, "path", "left").withColumn("accessed_at", F.greatest("accessed_at", F.coalesce("_ts", "accessed_at"))).select(*ENTITY_COLUMNS)


def resolve_renames(renames: DataFrame) -> DataFrame:
    """``old, new`` with chains followed to their ends; paths in a cycle stay where they are.

    Doubling: each round replaces a target by its own target, so a chain of n takes log n rounds.
    """
    now = cut(renames.select("old", "new").where(F.col("old") != F.col("new")).dropDuplicates(["old"]))
    n, rounds, most = now.count(), 0, 0
    while (1 << most) < n + 1:
        most += 1
    while rounds <= most:
        step = now.select(F.col("old").alias("new"), F.col("new").alias("further"))
        now = cut(now.join(step, "new", "left").select("old", F.coalesce("further", "new").alias("new"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("old", "new")
        now, rounds = now.select("old", "new"), rounds + 1
    return now.join(now.select(F.col("old").alias("new")), "new", "left_anti").select("old", "new")


def rename_outcome(entities: DataFrame, renames: DataFrame) -> DataFrame:
    """``old, new, outcome``: renamed, conflict_resolved or old_not_found."""
    there = entities.select(F.col("path").alias("old"), F.lit(True).alias("_o"))
    target = entities.select(F.col("path").alias("new"), F.lit(True).alias("_n"))
    state = F.when(F.col("_o").isNull(), "old_not_found").when(F.col("_n").isNotNull(), "conflict_resolved").otherwise("renamed")
    return renames.join(there, "old", "left").join(target, "new", "left").select("old", "new", state.alias("outcome"))


def rename(entities: DataFrame, relations: DataFrame, history: DataFrame, renames: DataFrame, at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a chain-free map ``old, new`` with distinct targets: entities, edges and history move.

    A row at a target gives way without an event; names follow; edges stay a set.
    """
    done = rename_outcome(entities, renames).where(F.col("outcome") != "old_not_found").select("old", "new")
    victims = done.join(entities.select(F.col("path").alias("new")), "new", "left_semi").select(F.col("new").alias("path"))
    rest = entities.join(victims, "path", "left_anti")
    moved = rest.join(done.withColumnRenamed("old", "path"), "path", "left").withColumn("_was", F.col("path")).withColumn("path", F.coalesce("new", "path"))
    is_new = F.col("new").isNotNull()
    moved = moved.withColumn("name", F.when(is_new, basename(F.col("path"))).otherwise(F.col("name"))).withColumn("extension", F.when(is_new, extension(basename(F.col("path")))).otherwise(F.col("extension")))
    events = moved.where(is_new).select(
        F.col("id").alias("entity_id"), "path", F.lit("renamed").alias("event"), F.lit(None).cast("string").alias("old_lifecycle"), F.lit(None).cast("string").alias("new_lifecycle"),
        F.col("_was").alias("old_path"), "size_bytes", "content_hash", F.lit(at).cast("long").alias("recorded_at"), F.lit(0).alias("seq"),
    )
    edges = without_edges(relations, victims)
    for end in ("from_path", "to_path"):
        edges = edges.join(done.select(F.col("old").alias(end), F.col("new").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    past = history.join(done.select(F.col("old").alias("path"), F.col("new").alias("_to")), "path", "left").withColumn("path", F.coalesce("_to", "path")).drop("_to").select(*history.columns)
    return moved.select(*ENTITY_COLUMNS), upsert_edges(edges.limit(0), edges), past.unionByName(events.select(*[f.name for f in HISTORY]))


def upsert_edges(relations: DataFrame, new: DataFrame) -> DataFrame:
    """A set of (from, to, kind); the earliest creation stays."""
    return relations.unionByName(new).groupBy("from_path", "to_path", "kind").agg(F.min("created_at").alias("created_at"))


def replace_outgoing(relations: DataFrame, extracted: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges from the paths of ``sources`` give way to the ones extracted from them."""
    rest = relations.join(sources.select(F.col("path").alias("from_path")).distinct(), "from_path", "left_anti")
    return upsert_edges(rest.select("from_path", "to_path", "kind", "created_at"), extracted)


def upsert_by_path(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Full-text or vector rows: those of ``new`` replace all of the same path."""
    return rows.join(new.select("path").distinct(), "path", "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def vector_upsert(vectors: DataFrame, texts: DataFrame, at: int, embed=None, load=None) -> DataFrame:
    """The vector table after ``texts(path, content_hash, text)``: rows whose content is known stay and aren't embedded."""
    from loam.operators import search

    work = texts.join(vectors.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
    return upsert_by_path(vectors, search.vector_rows(work.select("path", "content_hash", "text"), embed or search.embed_hashed, at, load))


def move_paths(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows of renamed paths, moved in place."""
    return rows.join(renames.select(F.col("old").alias("path"), "new"), "path", "left").withColumn("path", F.coalesce("new", "path")).select(*rows.columns)


def clean_plan(entities: DataFrame, relations: DataFrame, on_disk: DataFrame, now: int, dead_only: bool = False, stale_only: bool = False) -> DataFrame:
    """``what, path, other``: what a clean would remove after a refresh. Nothing is written."""
    from loam.operators.graph import stale_relations
    from loam.operators.lifecycle import refreshed

    new = refreshed(entities, on_disk, now).select("path", "new_lifecycle")
    current = entities.join(new, "path", "left").withColumn("lifecycle", F.coalesce("new_lifecycle", "lifecycle")).drop("new_lifecycle")
    rows = dead(current).select(F.lit("dead").alias("what"), "path", F.lit(None).cast("string").alias("other"))
    stale = stale_relations(relations, entities).select(F.lit("stale").alias("what"), F.col("from_path").alias("path"), F.col("to_path").alias("other"))
    return stale if stale_only else rows if dead_only else rows.unionByName(stale)
