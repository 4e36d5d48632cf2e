"""Connected components of a graph given by its links, by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import cut


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every end of ``links(a, b)``: the smallest id that is reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by
    doubling, and contracts the links to those ends. Nothing is collected; a round is a few joins on
    tables that shrink. Links that are loops, repeated, or null on a side are harmless.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    edges = cut(links.union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = None
    while True:
        point = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        if point.isEmpty():
            return labels if labels is not None else point
        while True:
            up = point.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = point.join(up, "root").select("id", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
            jumped = cut(jumped)
            point = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = point
        else:
            labels = cut(labels.join(point.select(F.col("id").alias("root"), F.col("root").alias("above")), "root", "left").select("id", F.coalesce("above", "root").alias("root")))
        roots = point.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        left = edges.join(roots, "a").select("ra", "b")
        both = left.join(roots.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        edges = cut(both.where(F.col("ra") != F.col("rb")).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
