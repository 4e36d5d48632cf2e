"""Exact ball k-means over integer vectors.

A cluster is a ball: its centroid, and a radius that no member lies beyond. A round is one pass:

1. From the clusters' sums come the new centroids, and from the largest distances of the last pass
   the new radii: the old radius plus the way that the centroid moved bounds the new one.
2. A centroid ``j`` is a neighbour of ball ``i`` if half its distance from centroid ``i`` is within
   ``i``'s radius. No other centroid can be nearer to a member, or as near.
3. A member of ball ``i`` whose distance is below half that of the nearest neighbour is in the stable
   core and stays. The rest lie in annuli between the half distances of ``i``'s neighbours in
   ascending order: a member of the ``n``-th annulus is compared with the first ``n`` neighbours only.

All distances are squared and integers, so nothing is rounded: a member at exactly half the way is
compared, and ties go to the smaller number. The first round starts from one ball without a bound.
Vectors never leave their partition; a pass writes them with their cluster to the shared folder. Of a
pass, ``k * (width + 2)`` numbers meet on the driver, whatever the input.

Edge cases: vectors that are null, of another width, or hold null or non-finite components take no
part, nor do those with a scaled component beyond ``LARGEST``, whose distances a long can't hold; a
null id is a row like others but never a start; equal vectors are rows of their own; of equal ids the
smaller vector starts first; with fewer vectors than ``k`` there are as many centroids; an empty
cluster keeps its centroid; an inertia that a long can't hold is null; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import bytework as bw
from loam.session import cut

SCALE = 64
WIDTH = 64
CLUSTERS = 16
ROUNDS = 3
LARGEST = 1 << 25
_BLOCK = 4096


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors that take part, each component ``floor(scale * x)``."""
    x = F.col(vector_col)
    d = lambda c: c.cast("double")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(d(c)) & (F.abs(d(c)) * scale <= F.lit(float(LARGEST - 1))))
    # an element of the condition may be tested on rows that an earlier one rejects, so floors are taken of kept rows only
    v = F.when(ok & (F.size(x) == width), F.transform(x, lambda c: F.floor(d(c) * scale).cast("int")))
    return rows.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull())


def starts(rows: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The ``k`` vectors whose ``seed:id`` has the smallest SHA-256."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in rows.where(F.col("vec_id").isNotNull()).select("v", by.alias("by")).orderBy("by", "v").limit(k).collect()]


class Balls:
    """Centroids, and the neighbours of each by ascending distance."""

    def __init__(self, centroids: list[list[int]], radii: list[int | None]):
        self.centroids = np.array(centroids, np.int64)
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        for i, c in enumerate(centroids):
            apart = [sum((a - b) ** 2 for a, b in zip(c, o)) for o in centroids]
            met = sorted((apart[j], j) for j in range(len(centroids)) if j != i and (radii[i] is None or apart[j] <= 4 * radii[i] ** 2))
            self.near.append((np.array([j for _, j in met], np.int64), np.array([d for d, _ in met], np.int64)))

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each row of ``x``, which are in ``cluster`` so far, and the distances taken."""
        best, out, taken = np.zeros(len(x), np.int64), cluster.copy(), len(x)
        for i, (other, apart) in enumerate(self.near):
            at = np.flatnonzero(cluster == i)
            if not len(at):
                continue
            best[at] = own = ((x[at] - self.centroids[i]) ** 2).sum(1)
            annulus = np.searchsorted(apart, 4 * own, "right")  # 0: the stable core
            for n, j in enumerate(other.tolist()):
                far = at[annulus > n]
                if not len(far):
                    break
                d = ((x[far] - self.centroids[j]) ** 2).sum(1)
                taken += len(far)
                wins = (d < best[far]) | ((d == best[far]) & (j < out[far]))
                best[far[wins]], out[far[wins]] = d[wins], j
        return out, best, taken


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assigned(rows: DataFrame, balls: Balls) -> DataFrame:
    """``vec_id, v, cluster, distance`` of ``rows(vec_id, v, cluster)``."""
    width = balls.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                p = b.slice(at, _BLOCK)
                cluster, distance, _ = balls.assign(_matrix(p.column(1), width), p.column(2).to_numpy().astype(np.int64))
                yield pa.record_batch([p.column(0), p.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])
        bw.give_back()

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, distance long")


def totals(rows: DataFrame, k: int, width: int) -> tuple[list[int], list[int], list[list[int]]]:
    """(members, largest squared distance, componentwise sums) of each cluster; a partition sends one row for each."""

    def run(batches):
        n, most, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            x, cluster, distance = _matrix(b.column(0), width), b.column(1).to_numpy(), b.column(2).to_numpy()
            for i in np.unique(cluster).tolist():
                own = cluster == i
                n[i] += int(own.sum())
                most[i] = max(most[i], int(distance[own].max()))
                sums[i] += x[own].sum(0)
        has = np.flatnonzero(n)
        yield pa.record_batch([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(most[has]), pa.array(list(sums[has]), pa.list_(pa.int64()))], names=["cluster", "n", "most", "sums"])

    parts = rows.select("v", "cluster", "distance").mapInArrow(run, "cluster int, n long, most long, sums array<long>")
    long = parts.select("cluster", "n", "most", F.posexplode("sums").alias("k", "s"))
    met = long.groupBy("cluster", "k").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("s").alias("s")).collect()
    n, most, sums = [0] * k, [0] * k, [[0] * width for _ in range(k)]
    for r in met:
        n[r["cluster"]], most[r["cluster"]] = r["n"], r["most"]
        sums[r["cluster"]][r["k"]] = r["s"]
    return n, most, sums


def _up(square: int) -> int:
    """The root, rounded up."""
    return isqrt(square - 1) + 1 if square else 0


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``rows(vec_id, v)``."""
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    rows = cut(rows.withColumn("cluster", F.lit(0)))
    centroids = starts(rows, k)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    radii: list[int | None] = [None] * len(centroids)
    for _ in range(rounds):
        rows = cut(assigned(rows, Balls(centroids, radii)))
        n, most, sums = totals(rows, len(centroids), width)
        moved = [[s // m for s in t] if m else c for c, m, t in zip(centroids, n, sums)]
        way = [sum((a - b) ** 2 for a, b in zip(c, d)) for c, d in zip(centroids, moved)]
        radii = [_up(a) + _up(b) for a, b in zip(most, way)]
        centroids = moved
    rows = cut(assigned(rows, Balls(centroids, radii)).drop("v"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    by = rows.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("cluster_inertia"))
    all_ = rows.agg(F.expr("try_sum(distance)").alias("inertia"))
    facts = by.join(F.broadcast(all_)).join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
