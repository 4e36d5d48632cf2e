"""Context packs: ranked files with snippets, edges and history within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.find import in_scope
from loam.operators.search import latest_per_path

LEAST_BUDGET, EXCERPT_CHARS, ITEM_COST, EDGES, EVENTS = 512, 1200, 256, 8, 3


def budgeted(items: DataFrame, budget: int) -> DataFrame:
    """``items(rank, path, snippet)`` up to and with the one that uses up the budget.

    An item costs its path and snippet in bytes and a fixed share, so only so many of the first ranks
    can be in; those are one ordered list, and the running sum has one partition.
    """
    budget = max(budget, LEAST_BUDGET)
    items = items.orderBy("rank").limit(budget // ITEM_COST + 1)
    cost = F.octet_length("path") + F.coalesce(F.octet_length("snippet"), F.lit(0)) + ITEM_COST
    before = F.sum("cost").over(Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return items.withColumn("cost", cost.cast("long")).withColumn("spent_before", F.coalesce(before, F.lit(0))).where(F.col("spent_before") < budget)


def enriched(items: DataFrame, entities: DataFrame, relations: DataFrame, history: DataFrame, scope: str | None = None) -> DataFrame:
    """With lifecycle and summary, up to eight edges in scope and the three latest events."""
    inside = relations.where(in_scope(F.col("from_path"), scope) & in_scope(F.col("to_path"), scope))
    paths = items.select("path")
    ends = inside.select(F.col("from_path").alias("path"), "from_path", "to_path", "kind").union(inside.where("from_path <> to_path").select(F.col("to_path"), "from_path", "to_path", "kind"))
    near = latest_per_path(ends.join(paths, "path", "left_semi"), "path", [F.col("from_path"), F.col("to_path"), F.col("kind")], EDGES)
    edges = near.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("from_path", "to_path", "kind"))).alias("relations"))
    recent = latest_per_path(history.join(paths, "path", "left_semi"), "path", [F.col("recorded_at").desc(), F.col("seq").desc()], EVENTS)
    events = recent.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("recorded_at", "seq", "event")), asc=False).alias("recent_history"))
    known = entities.select("path", "lifecycle", "summary")
    return items.join(known, "path", "left").join(edges, "path", "left").join(events, "path", "left")


def with_snippets(hits: list[dict], budget: int, read) -> list[dict]:
    """The driver's form for hits without stored previews: an excerpt depends on what is left.

    ``read(path, n)`` gives the first ``n`` characters of a file or None.
    """
    left, out = max(budget, LEAST_BUDGET), []
    for hit in hits:
        if left <= 0:
            break
        snippet = hit.get("text_preview") or read(hit["path"], min(left, EXCERPT_CHARS))
        left = max(0, left - len(hit["path"].encode()) - len((snippet or "").encode()) - ITEM_COST)
        out.append({**hit, "snippet": snippet})
    return out


def with_seed(hits: list[dict], seed: str | None, scope: str) -> list[dict]:
    """The seed first, with score 1, unless it was found or is out of scope."""
    inside = seed is not None and (seed == scope or seed.startswith(scope.rstrip("/") + "/"))
    if inside and all(h["path"] != seed for h in hits):
        return [{"path": seed, "score": 1.0, "source": "seed"}, *hits]
    return hits
