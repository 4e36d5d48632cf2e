"""The write path: scans, incremental index runs, and the start of a watch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.operators import diff, lifecycle, maintain, search
from loam.plans.catalog import Catalog
from loam.schema import ENTITY_COLUMNS, HISTORY, MAX_TEXT_CHARS
from loam.session import cut
from loam.sources import scan
from loam.sources.paths import IgnoreSet, sensitive_reason


def rescan(entities: DataFrame, relations: DataFrame, history: DataFrame, listing: DataFrame, now: int, root: str | None = None, ignore: IgnoreSet | None = None, reconcile: bool = True, dormant: int = 30, archive: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables after a scan: renames by content first, then upserts, then the lifecycle refresh.

    The thresholds go to the scan and to the refresh alike, so a second scan changes nothing.
    """
    found = cut(scan.to_entities(listing, now, ignore, dormant=dormant, archive=archive))  # new ids are drawn once
    if reconcile:
        renames = cut(diff.rename_candidates(entities, found, root))
        entities, relations, history = map(cut, maintain.rename(entities, relations, history, renames, now))
    history = history.unionByName(maintain.upsert_history(entities, found, now).select(*[f.name for f in HISTORY]))
    entities = cut(maintain.upsert(entities, found))
    changed = lifecycle.refreshed(entities, found, now, dormant, archive).withColumn("lifecycle", F.col("new_lifecycle")).select(*ENTITY_COLUMNS)
    history = history.unionByName(maintain.upsert_history(entities, changed, now).select(*[f.name for f in HISTORY]))
    return cut(maintain.upsert(entities, changed)), relations, cut(history)


def extracted_files(files: DataFrame) -> DataFrame:
    """``path, content, error`` of files with their bytes: the text of each, or why it can't be read."""
    got = scan.extracted(F.col("path"), F.col("content"))
    known = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    rows = files.select("path", known.alias("known"), got.alias("got"))
    return rows.select("path", F.substring("got.text", 1, MAX_TEXT_CHARS).alias("content"), F.coalesce("known", "got.error").alias("error"))


def index_once(entities: DataFrame, relations: DataFrame, texts: DataFrame | search.TextIndex, vectors: DataFrame, files: DataFrame, now: int, ignore: IgnoreSet = IgnoreSet(), scopes: list[str] | None = None, extra_sensitive: tuple[str, ...] = (), embed=search.embed_hashed) -> dict[str, DataFrame]:
    """An incremental run over ``files(path, content)``: vectors follow moved files, and only files
    whose text or vector is missing are read, indexed and searched for imports.

    ``content`` is text, or bytes that the text is extracted from (with the listing's ``error``, if
    there is one), file by file: a file that can't be read has the outcome ``error`` and the rest go
    on. ``texts`` is a table, whose new state is returned, or a ``TextIndex``, which takes the new texts
    in. ``outcomes`` has a row for each source entity; the other tables are the new states.
    """
    moved = diff.reconcile_by_hash(vectors.select("path", "content_hash"), entities)
    vectors = maintain.move_paths(vectors, moved)
    source = search_source(entities, scopes)
    reason = sensitive_reason(F.col("path"), extra_sensitive)
    held = texts.documents() if isinstance(texts, search.TextIndex) else texts
    if isinstance(files.schema["content"].dataType, T.BinaryType):
        # only files that the run is about are decoded: in scope, neither ignored nor sensitive nor up to date
        known = source.join(vectors.select("path", "content_hash"), ["path", "content_hash"], "left_semi").join(held.select("path"), "path", "left_semi").select("path")
        asked = source.where(~ignore.ignored(F.col("path")) & reason.isNull()).select("path").join(known, "path", "left_anti")
        files = cut(extracted_files(files.join(asked, "path", "left_semi")))
    outcomes = cut(scan.index_run(source, vectors, held, files, ignore, reason))
    work = outcomes.where("outcome = 'indexed'").select("path")
    read = files.select("path", "content").join(work, "path", "left_semi").join(entities.select("path", "name", "content_hash"), "path")
    new_texts = search.fts_rows(read)
    new_vectors = search.vector_rows(read.select("path", "content_hash", F.col("content").alias("text")), embed, now)
    edges = scan.import_edges(read.select("path", "content"), entities.select("path")).withColumn("created_at", F.lit(now).cast("long"))
    out = {
        "outcomes": outcomes,
        "stats": scan.run_stats(outcomes),
        "vectors": maintain.upsert_by_path(vectors, new_vectors),
        "relations": maintain.replace_outgoing(relations, edges, work),
    }
    if isinstance(texts, search.TextIndex):
        texts.add(new_texts)
        return out
    return {**out, "texts": maintain.upsert_by_path(texts, new_texts)}


def index_into(catalog: Catalog, files: DataFrame, now: int, **options) -> int:
    """An index run over the catalog's tables; all that it changes is committed at once.

    The catalog has ``entities, relations, texts`` and ``vectors``; the run's ``outcomes`` are kept as a
    table of its generation.
    """
    tables = {name: catalog.read(name) for name in ("entities", "relations", "texts", "vectors")}
    got = index_once(**tables, files=files, now=now, **options)
    return catalog.commit(**{name: got[name] for name in ("relations", "texts", "vectors", "outcomes")})


def search_source(entities: DataFrame, scopes: list[str] | None) -> DataFrame:
    from loam.operators.find import indexer_source

    return indexer_source(entities, scopes).select("path", "content_hash")


def apply_actions(entities: DataFrame, relations: DataFrame, history: DataFrame, actions: DataFrame, files: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge a batch of the change feed so that the last action on each path decides.

    Paths that are deleted and then come back (by a create or as a rename's target) are deleted
    first; of several renames to one target the last one stays, and what the others moved is gone;
    then come renames, the other deletes, accesses and upserts. At one time, deletes come before
    renames and renames before upserts. ``files`` are entity rows of the paths that were created or
    changed; a path whose last action is a delete is not taken from them.
    """
    rank = F.when(F.col("action") == "delete", 0).when(F.col("action") == "rename", 1).otherwise(2)
    decided = actions.where(F.col("action").isin("delete", "rename", "upsert")).withColumn("_at", F.struct("ts", rank))
    last = cut(decided.groupBy("path").agg(F.max_by("action", "_at").alias("last"), F.max(F.when(F.col("action") == "rename", F.struct("_at", "old_path"))).alias("_r")))
    renames = last.where(F.col("_r").isNotNull()).select(F.col("_r.old_path").alias("old"), F.col("path").alias("new"))
    beaten = decided.where(F.col("action") == "rename").join(renames, (F.col("old_path") == F.col("old")) & (F.col("path") == F.col("new")), "left_anti").select(F.col("old_path").alias("path"))
    deleted = decided.where("action = 'delete'").select("path").distinct().join(last, "path")
    early = deleted.where("last <> 'delete'").select("path").unionByName(beaten).distinct()
    entities, relations, history = map(cut, maintain.delete(entities, relations, history, early, now))
    entities, relations, history = map(cut, maintain.rename(entities, relations, history, maintain.resolve_renames(renames), now))
    entities, relations, history = maintain.delete(entities, relations, history, deleted.where("last = 'delete'").select("path"), now)
    entities = maintain.touch(entities, actions.where("action = 'touch'").select("path", "ts"))
    new = files.join(last.where("last <> 'delete'").select("path"), "path", "left_semi")
    history = history.unionByName(maintain.upsert_history(entities, new, now).select(*[f.name for f in HISTORY]))
    return maintain.upsert(entities, new), relations, history
