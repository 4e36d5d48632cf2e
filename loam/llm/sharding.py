"""Sharding by sampled splitters, with DataFrame functions only.

The law is ``bytes``: shard sizes are near equal. Groups are equal texts: a group stays in one shard
unless it is larger than a shard's share, ``total / shards``.

1. Groups of a ``1 / HEAVY`` of a share or more are few (``HEAVY * shards`` at most, whatever the
   input); groups of ``PART_ROWS`` records or ``PART_BYTES`` count as heavy as well, so that no light
   text of many copies is one task (there are as many of them as parts, at most). Those within a
   share go first, the largest to the shard that has least; what they leave open, up to one common
   level, is each shard's room for the rest.
2. The rest is ordered by the text's hash. A size-weighted sample of these keys gives quantile
   boundaries, by which records are range-partitioned; each group larger than a share is a range of
   its own. A range is subdivided into as many parts of its keys' interval (of its ids' hashes, in a
   range of one group) as its counted rows and bytes ask for (``PART_ROWS``, ``PART_BYTES``), so
   parts grow in number with the input and not in size.
3. Rows and sizes run within a part; the parts' totals run within a range; only the ranges' totals
   (``RANGES`` for a shard and the groups of 1.) meet on the driver. A group goes to the
   shard in whose room its middle lies; of a group larger than a share, each record does.

A shard is over the level by less than ``1 / (2 * HEAVY)`` of a share and one record larger than
a share's ``1 / HEAVY``. The result doesn't depend on the sample.

Texts never move: the order, the sizes and the splitters work on five numbers a record. A text of
any length is one record, which is never cut.

Edge cases: a null text is empty (size 16) and of the empty texts' group; a null doc_id is a record
like others; fully repeated rows each get a slot of their own; records that tie in text, id hash
and id are alike, so their order doesn't show; an empty table gives an empty result; further input
columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.session import cut

RECORD_OVERHEAD = 16
HEAVY = 8
RANGES = 8
PART_ROWS = 500_000
PART_BYTES = 1 << 31


def keys_of(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, key, low``: what sharding needs of a record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + RECORD_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id")).alias("low"),
    )


def splitters(keys: DataFrame, total: int, ranges: int, oversample: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample: each byte is drawn with equal chance.

    A record is drawn if a hash of it falls below ``size * rate``; the sample has about
    ``ranges * oversample`` keys whatever the input, and heavier records are drawn once at most.
    """
    rate = ranges * oversample / max(1, total)
    u = (F.xxhash64(F.col("key"), F.col("low"), F.lit(71)).cast("double") / F.lit(2.0**64)) + 0.5
    sample = [r["key"] for r in keys.where(u < F.col("size") * rate).select("key").orderBy("key").collect()]
    step = max(1, len(sample) // ranges)
    return sorted(set(sample[step::step]))[: ranges - 1]


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``: binary search written as nested conditions."""

    def split(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), split(lo, mid)).otherwise(split(mid + 1, hi))

    return split(0, len(bounds))


def place_heavy(groups: list[tuple[int, int]], total: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """(shard of each heavy group, each shard's room for the rest); groups are (key, bytes)."""
    loads = [(0, s) for s in range(shards)]
    at = {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        load, s = heapq.heappop(loads)
        at[key] = s
        heapq.heappush(loads, (load + size, s))
    held = [load for load, _ in sorted(loads, key=lambda x: x[1])]
    rest, filled = total - sum(held), sorted(held)
    n = shards  # the level that the rest fills the emptiest shards up to
    while n > 1 and filled[n - 1] * n > rest + sum(filled[:n]):
        n -= 1
    level, over = divmod(rest + sum(filled[:n]), n)
    room = [max(0, level - x) for x in held]
    for s in [s for s in range(shards) if held[s] <= level][:over]:
        room[s] += 1
    return at, room


def shard(docs: DataFrame, shards: int = 40, oversample: int = 32) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every record."""
    spark = docs.sparkSession
    empty = "doc_id {}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int".format(docs.schema["doc_id"].dataType.simpleString())
    keys = cut(keys_of(docs))
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], empty)
    share = total / shards
    weights = keys.groupBy("key").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    weights = weights.where((F.col("b") * (HEAVY * shards) >= total) | (F.col("n") >= PART_ROWS) | (F.col("b") >= PART_BYTES))
    large = [(r["key"], r["b"]) for r in weights.collect()]  # HEAVY * shards, and one for each part of the input, at most
    at, room = place_heavy([g for g in large if g[1] <= share], total, shards)
    own = sorted(at) + sorted(k for k, b in large if b > share)  # ranges of one group: placed, then larger than a share
    n_ranges = shards * RANGES
    ranges = spark.createDataFrame([(k, n_ranges + i) for i, k in enumerate(own)], "key long, own int")
    ranged = keys.join(F.broadcast(ranges), "key", "left")
    bounds = splitters(ranged.where(F.col("own").isNull()), total, n_ranges, oversample)
    ranged = ranged.withColumn("range", F.coalesce("own", range_of(F.col("key"), bounds)))
    ranged = ranged.withColumn("by", F.when(F.col("own").isNull(), F.col("key")).otherwise(F.col("low"))).drop("own")
    facts = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.min("by").alias("least"), F.max("by").alias("most")).collect()
    facts = sorted(facts, key=lambda r: r["range"])
    rows_before, bytes_before, known = 0, 0, []
    placed_rows: dict[int, int] = {}  # of the heavy groups that a shard holds so far
    for r in facts:
        parts = max(1, -(-r["n"] // PART_ROWS), -(-r["b"] // PART_BYTES))
        home = at.get(own[r["range"] - n_ranges]) if r["range"] >= n_ranges else None
        known.append((r["range"], r["least"], float(r["most"] - r["least"] + 1), parts, home, placed_rows.get(home, 0) if home is not None else rows_before, bytes_before))
        if home is None:
            rows_before, bytes_before = rows_before + r["n"], bytes_before + r["b"]
        else:
            placed_rows[home] = placed_rows.get(home, 0) + r["n"]
    table = F.broadcast(spark.createDataFrame(known, "range int, least long, width double, parts int, home int, range_rows long, range_bytes long"))
    far = (F.col("by").cast("double") - F.col("least").cast("double")) / F.col("width")
    dealt = ranged.join(table, "range").withColumn("part", F.least(F.floor(far * F.col("parts")).cast("int"), F.col("parts") - 1))
    order = Window.partitionBy("range", "part").orderBy("key", "low", F.col("doc_id").asc_nulls_first(), "size")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "part", "key")
    placed = dealt.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum("size").over(run))
    placed = placed.withColumn("first", F.min(F.col("upto") - F.col("size")).over(group)).withColumn("last", F.max("upto").over(group))
    placed = cut(placed)
    sums = placed.groupBy("range", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    earlier = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long")
    parts = sums.select("range", "part", before("n").alias("part_rows"), before("b").alias("part_bytes"))
    largest_group = n_ranges + len(at)
    middle = F.when(F.col("range") < largest_group, (F.col("first") + F.col("last")) / 2).otherwise(F.col("upto") - F.col("size") / 2)
    edges = [sum(room[: s + 1]) for s in range(shards - 1)]
    offset = F.col("range_bytes") + F.col("part_bytes") + F.floor(middle).cast("long")
    located = placed.join(parts, ["range", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "home",
        (F.col("range_rows") + F.col("part_rows") + F.col("nth") - 1).alias("position"),
        F.coalesce("home", range_of(offset, edges)).alias("shard"),
    )
    firsts = located.where(F.col("home").isNull()).groupBy("shard").agg(F.min("position").alias("first"), F.count("*").alias("streamed"))
    return located.join(F.broadcast(firsts), "shard", "left").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.when(F.col("home").isNull(), F.col("position") - F.col("first")).otherwise(F.col("position") + F.coalesce("streamed", F.lit(0))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
