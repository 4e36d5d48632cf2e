"""Graph operators over path-keyed edges ``from_path, to_path, kind``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.scalars import risk_level
from loam.operators.cycles import elementary_cycles
from loam.operators.find import in_scope
from loam.schema import MAX_GRAPH_DEPTH
from loam.session import cut, stored

BROADCAST_PATHS = 200_000


def stale_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that lack an entity at an end."""
    paths = entities.select("path").distinct()
    src = relations.join(paths.select(F.col("path").alias("from_path"), F.lit(True).alias("_s")), "from_path", "left")
    both = src.join(paths.select(F.col("path").alias("to_path"), F.lit(True).alias("_d")), "to_path", "left")
    return both.where(F.col("_s").isNull() | F.col("_d").isNull()).select("from_path", "to_path", "kind")


def live_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that have an entity at both ends: two semi-joins."""
    paths = entities.select("path").distinct()
    half = relations.join(paths.select(F.col("path").alias("from_path")), "from_path", "left_semi")
    return half.join(paths.select(F.col("path").alias("to_path")), "to_path", "left_semi").select(*relations.columns)


def relations_of(relations: DataFrame, path: str) -> DataFrame:
    return relations.where((F.col("from_path") == path) | (F.col("to_path") == path)).select("from_path", "to_path", "kind")


def reverse_deps(relations: DataFrame, path: str, depth: int = 5) -> DataFrame:
    """``path, kind, depth``: everything that reaches ``path`` in at most ``depth`` hops, at its least depth.

    ``kind`` is the smallest of the edges that reach a node at its depth.
    """
    return reverse_deps_many(relations, [path], depth).drop("start")


STARTS_A_WORD = 62


def reverse_deps_many(relations: DataFrame, starts: list[str], depth: int = 5) -> DataFrame:
    """``start, path, kind, depth`` of the walks back from a stated list of starts, in one walk.

    The frontier is keyed by node and has the starts that reach it as bits, ``STARTS_A_WORD`` to a
    row, so starts that share their way share its rows. A hop joins the frontier with the edges once,
    without a shuffle while the frontier and what was seen are small (both are counted), and takes
    away the bits that were seen; the walk ends when none are left. Stored edges are read where they
    are, others are written once for all hops.
    """
    spark = relations.sparkSession
    starts = list(dict.fromkeys(starts))
    edges = stored(relations.select("from_path", "to_path", "kind"))
    rows = [(s, i // STARTS_A_WORD, 1 << i % STARTS_A_WORD) for i, s in enumerate(starts)]
    last = spark.createDataFrame(rows, "path string, word int, bits long")
    n_seen = n_new = len(rows)
    parts, found = [last], []
    together = lambda df, name: df.groupBy("path", "word").agg(F.bit_or("bits").alias(name))
    for hop in range(1, depth + 1):
        frontier, seen = together(last, "bits"), together(reduce(DataFrame.unionByName, parts), "old")
        step = edges.join(_small(frontier.withColumnRenamed("path", "to_path"), n_new), "to_path").groupBy(F.col("from_path").alias("path"), "word", "kind").agg(F.bit_or("bits").alias("bits"))
        met = step.join(_small(seen, n_seen), ["path", "word"], "left")
        left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        new = cut(met.select("path", "word", "kind", left.alias("bits")).where("bits <> 0"))
        n_new = new.count()  # at least as many as the frontier has
        if not n_new:
            break
        n_seen += n_new
        last = new.select("path", "word", "bits")
        parts.append(last)
        found.append(new.withColumn("depth", F.lit(hop)))
    if not found:
        return spark.createDataFrame([], "start string, path string, kind string, depth int")
    every = reduce(DataFrame.unionByName, found)
    bit = F.explode(F.sequence(F.lit(0), F.lit(STARTS_A_WORD - 1))).alias("bit")
    single = every.select("*", bit).where(F.expr("shiftright(bits, bit) & 1 = 1")).groupBy("path", "depth", (F.col("word") * STARTS_A_WORD + F.col("bit")).alias("at")).agg(F.min("kind").alias("kind"))
    names = F.broadcast(spark.createDataFrame(list(enumerate(starts)), "at int, start string"))  # the stated list
    return single.join(names, "at").select("start", "path", "kind", "depth")


def _small(paths: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if its counted rows allow it."""
    return F.broadcast(paths) if rows <= BROADCAST_PATHS else paths


def impact_of(hit: DataFrame, path: str) -> DataFrame:
    """``path, total, direct, risk`` of what a walk back from ``path`` has reached."""
    total = hit.agg(F.count("*").alias("total"), F.count_if(F.col("depth") == 1).alias("direct"))
    return total.select(F.lit(path).alias("path"), "total", "direct", risk_level(F.col("total")).alias("risk"))


def impact_of_many(hit: DataFrame, starts: list[str]) -> DataFrame:
    """The same of a walk from several starts, a row for each, those that nothing reaches as well."""
    spark = hit.sparkSession
    counted = hit.groupBy(F.col("start").alias("path")).agg(F.count("*").alias("total"), F.count_if(F.col("depth") == 1).alias("direct"))
    asked = spark.createDataFrame([(s,) for s in dict.fromkeys(starts)], "path string")
    total = F.coalesce("total", F.lit(0))
    return F.broadcast(asked).join(counted, "path", "left").select("path", total.alias("total"), F.coalesce("direct", F.lit(0)).alias("direct"), risk_level(total).alias("risk"))


def impact_summary(relations: DataFrame, path: str, depth: int = 5, scope: str | None = None) -> DataFrame:
    """``path, total, direct, risk``; the scope filters what was reached, not the way there."""
    return impact_of(reverse_deps(relations, path, depth).where(in_scope(F.col("path"), scope)), path)


def neighbourhood_nodes(relations: DataFrame, path: str, depth: int = 1, max_nodes: int | None = None) -> DataFrame:
    """``path, depth`` of an undirected walk of at most three hops; the start has depth 0."""
    spark = relations.sparkSession
    relations = stored(relations.select("from_path", "to_path"))
    ways = relations.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")).union(relations.select(F.col("to_path"), F.col("from_path")))
    seen = frontier = spark.createDataFrame([(path, 0)], "path string, depth int")
    for hop in range(1, min(depth, MAX_GRAPH_DEPTH) + 1):
        step = ways.join(frontier.select(F.col("path").alias("a")), "a").select(F.col("b").alias("path")).distinct()
        new = cut(step.join(seen.select("path"), "path", "left_anti").withColumn("depth", F.lit(hop)))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen.orderBy("depth", "path").limit(max_nodes) if max_nodes else seen


def neighbourhood_edges(relations: DataFrame, nodes: DataFrame, depth: int, scope: str | None = None) -> DataFrame:
    """Edges of the nodes that were expanded: those nearer than the depth limit."""
    depth = min(depth, MAX_GRAPH_DEPTH)
    inner = nodes.where(F.col("depth") < depth).select("path")
    out = relations.join(inner.withColumnRenamed("path", "from_path"), "from_path", "left_semi").select("from_path", "to_path", "kind")
    into = relations.join(inner.withColumnRenamed("path", "to_path"), "to_path", "left_semi").select("from_path", "to_path", "kind")
    return out.union(into).distinct().where(in_scope(F.col("from_path"), scope) & in_scope(F.col("to_path"), scope))


def cycles(relations: DataFrame, max_length: int | None = None) -> DataFrame:
    """``cycle``: all elementary cycles of two nodes or more, closed, from their smallest node.

    They are looked for within strongly connected components only (``operators.cycles``);
    ``max_length`` leaves out cycles of more nodes, on request.
    """
    return elementary_cycles(relations.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")), max_length)


def history_of(history: DataFrame, path: str, limit: int = 0) -> DataFrame:
    """Newest first; a limit of 0 means 50."""
    return history.where(F.col("path") == path).orderBy(F.col("recorded_at").desc(), F.col("seq").desc()).limit(limit or 50)


def history_text(history: DataFrame) -> DataFrame:
    """A detail line for each event."""
    e = F.col("event")
    text = (
        F.when(e == "created", F.concat(F.lit("state "), F.coalesce("new_lifecycle", F.lit("-"))))
        .when(e == "lifecycle", F.concat_ws(" -> ", F.coalesce("old_lifecycle", F.lit("-")), F.coalesce("new_lifecycle", F.lit("-"))))
        .when(e == "modified", F.concat(F.lit("hash "), F.coalesce(F.substring("content_hash", 1, 8), F.lit("-"))))
        .when(e == "renamed", F.concat(F.lit("from "), F.coalesce("old_path", F.lit("-"))))
        .when(e == "deleted", F.concat(F.lit("was "), F.coalesce("old_lifecycle", F.lit("-"))))
    )
    return history.withColumn("detail", text)
