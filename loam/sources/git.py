"""Metadata of files from a version history, followed through renames.

``read_log`` reads the text that this command writes, one record a commit, in any number of tasks::

    git -c core.quotePath=off log --name-status -M --format=%x1e%at%x1f%an

``follow`` gives every path's time of creation, last change and most frequent author over all commits
of the file, under whatever name it had. A path's changes between two renames onto it are a *stretch*;
a rename (or a copy) onto a path starts one, whose parent is the stretch that the old path was in just
before: an as-of join. Parents of parents are found by pointer doubling, and a path's ancestors at any
distance from the doubled pointers, so a file renamed ``n`` times takes ``log n`` rounds.

Edge cases: a commit whose head line can't be read (time or author missing) nulls the result of every
file that it touches, at any of its names; authors that tie go by the smallest name; a path that was
deleted and written anew goes on as the same file; a path that was renamed away keeps what it was, for
paths are listed and not files on disk; status lines that can't be read are left out; an empty log
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.session import cut

RECORD, FIELD = "\x1e", "\x1f"
#: Before everything else.
OLDEST = (1 << 63) - 1


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``path, old_path, status, nth, ts, author``: a row for each file of each commit, the newest commit first (``nth`` 0).

    ``nth`` follows the order in the file and has gaps.
    """
    text = spark.read.option("lineSep", RECORD).text(path)
    placed = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    commits = placed.where(F.trim("value") != "")
    # within a block rows are in order; blocks are ordered by their place in the file
    blocks = cut(commits.groupBy("file", "block").agg(F.min("row").alias("least"), (F.max("row") - F.min("row") + 1).alias("n")))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.withColumn("start", F.coalesce(before, F.lit(0))).select("file", "block", "least", "start")
    lines = F.split("value", "\n")
    head = F.regexp_extract(lines[0], rf"^(\d+){FIELD}(.+)$", 1)
    one = commits.join(starts, ["file", "block"]).select(
        (F.col("start") + F.col("row") - F.col("least")).alias("nth"),
        F.when(head != "", head.cast("long")).alias("ts"),
        F.when(head != "", F.regexp_extract(lines[0], rf"^(\d+){FIELD}(.+)$", 2)).alias("author"),
        F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"),
    )
    part = F.split("line", "\t")
    moved = F.substring("line", 1, 1).isin("R", "C")
    good = F.col("line").rlike(r"^[AMDT]\t[^\t]+$|^[RC]\d*\t[^\t]+\t[^\t]+$")
    return one.where(good).select(F.when(moved, F.get(part, F.lit(2))).otherwise(part[1]).alias("path"), F.when(moved, part[1]).alias("old_path"), F.substring("line", 1, 1).alias("status"), "nth", "ts", "author")


def stretches(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``path, born, parent_path, parent_born`` of every stretch; ``records`` with ``born``).

    ``born`` is the ``nth`` of the rename that starts the stretch, ``OLDEST`` for a path's first one.
    """
    births = cut(records.where(F.col("status").isin("R", "C") & F.col("old_path").isNotNull()).groupBy("path", "nth").agg(F.max("old_path").alias("old_path")))
    # of a path, the last birth at or before each record, in the order from the oldest to the newest
    order = Window.partitionBy("path").orderBy(F.col("nth").desc(), "asks").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(None)

    def as_of(asked: DataFrame) -> DataFrame:
        """``asked`` with the stretch of ``path`` that holds place ``nth``; only births and places are sorted."""
        marks = births.select("path", "nth", F.lit(0).alias("asks"), F.col("nth").alias("mark"), *[none.cast(f.dataType).alias(f.name) for f in asked.schema if f.name not in ("path", "nth")])
        both = marks.unionByName(asked.select("*", F.lit(1).alias("asks"), none.cast("long").alias("mark")))
        return both.withColumn("born", F.coalesce(F.last("mark", ignorenulls=True).over(order), F.lit(OLDEST))).where("asks = 1").drop("asks", "mark")

    placed = as_of(records)
    # just before the rename: the next older place
    parents = as_of(births.select(F.col("old_path").alias("path"), (F.col("nth") + 1).alias("nth"), F.col("path").alias("to"), F.col("nth").alias("at")))
    linked = parents.select(F.col("to").alias("path"), F.col("at").alias("born"), F.col("path").alias("parent_path"), F.col("born").alias("parent_born"))
    own = placed.select("path", "born").distinct()
    return own.join(linked, ["path", "born"], "left"), placed


def follow(records: DataFrame) -> DataFrame:
    """``path, created_at, modified_at, author`` of every path, over all names that its file has had."""
    own, placed = stretches(records)
    own, placed = cut(own), cut(placed)
    # of a parent's stretch only what is older than the rename belongs to the child
    pointer = own.where("parent_path is not null").select(F.struct("path", "born").alias("s"), F.struct(F.col("parent_path").alias("path"), F.col("parent_born").alias("born")).alias("up"), F.col("born").alias("after"))
    steps = []
    while not pointer.isEmpty():  # the parents at distance 1, 2, 4, ...
        steps.append(pointer)
        further = pointer.select(F.col("s").alias("up"), F.col("up").alias("next"), "after")
        pointer = cut(pointer.drop("after").join(further, "up").select("s", F.col("next").alias("up"), "after"))
    heads = own.groupBy("path").agg(F.min("born").alias("born"))  # the newest stretch
    reached = heads.select(F.col("path").alias("file"), F.struct("path", "born").alias("s"), F.lit(-1).cast("long").alias("after"))
    for step in reversed(steps):  # every distance is a sum of different powers of two
        reached = cut(reached.unionByName(reached.drop("after").join(step, "s").select("file", F.col("up").alias("s"), "after")))
    rows = placed.join(reached.select("file", F.col("s.path").alias("path"), F.col("s.born").alias("born"), "after"), ["path", "born"]).where(F.col("nth") > F.col("after"))
    broken = F.col("ts").isNull() | F.col("author").isNull()
    by = rows.groupBy("file", "author").agg(F.count("*").alias("n"), F.max(F.struct("nth", "ts")).alias("first"), F.min(F.struct("nth", "ts")).alias("last"), F.count_if(broken).alias("broken"))
    top = F.min(F.struct(-F.col("n"), "author")).alias("top")
    out = by.groupBy("file").agg(F.max("first").alias("first"), F.min("last").alias("last"), F.sum("broken").alias("broken"), top)
    good = F.col("broken") == 0
    return out.select(F.col("file").alias("path"), F.when(good, F.col("first.ts")).alias("created_at"), F.when(good, F.col("last.ts")).alias("modified_at"), F.when(good, F.col("top.author")).alias("author"))
