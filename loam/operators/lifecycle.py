"""Lifecycle: state from last access, refresh against a listing, and histograms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.schema import ARCHIVE_DAYS, DAY, DORMANT_DAYS, ENTITY, ENTITY_COLUMNS
from loam.session import cut


def compute_state(accessed_at: Column, now: int, dormant: int = DORMANT_DAYS, archive: int = ARCHIVE_DAYS) -> Column:
    """Whole days since the last access, truncated: active, dormant or archived."""
    days = F.floor(F.abs(F.lit(now) - accessed_at) / DAY) * F.signum(F.lit(now) - accessed_at)
    return F.when(days <= dormant, "active").when(days <= archive, "dormant").otherwise("archived")


def refreshed(entities: DataFrame, on_disk: DataFrame, now: int, dormant: int = DORMANT_DAYS, archive: int = ARCHIVE_DAYS) -> DataFrame:
    """Entities whose state changes, with ``new_lifecycle``: dead if no path of ``on_disk`` is theirs."""
    there = on_disk.select("path").distinct().withColumn("_there", F.lit(True))
    state = F.when(F.col("_there"), compute_state(F.col("accessed_at"), now, dormant, archive)).otherwise("dead")
    both = entities.join(there, "path", "left").withColumn("new_lifecycle", state).drop("_there")
    return both.where(~F.col("lifecycle").eqNullSafe(F.col("new_lifecycle")))


# --- entities stored by the day on which their state changes next

NEVER = -1  # the partition of what no passing of time changes


def due_day(accessed_at: Column, lifecycle: Column, now: int, dormant: int = DORMANT_DAYS, archive: int = ARCHIVE_DAYS) -> Column:
    """The first day (since 1970) on which the state that time gives differs from the stored one.

    Today if it does now already; ``NEVER`` for archived rows, and for dead ones, which only a
    listing or an event brings back.
    """
    today, state = now // DAY, compute_state(accessed_at, now, dormant, archive)
    # a state holds for whole days since the last access, so it ends within the day that this names
    later = F.when(state == "active", accessed_at + (dormant + 1) * DAY).when(state == "dormant", accessed_at + (archive + 1) * DAY)
    return F.when(lifecycle == "dead", NEVER).when(~lifecycle.eqNullSafe(state), today).otherwise(F.coalesce(F.floor(later / DAY), F.lit(NEVER))).cast("long")


class DueTable:
    """Entities in folders by ``due`` day, so a refresh reads those that are due and no others.

    A refresh writes the rows that it has read below their new days, in folders named by the refresh,
    and then gives up the folders that they came from. A marker file says how far it is: what a refresh
    without a commit has written doesn't count, and what a committed one has given up doesn't either,
    so one that is stopped anywhere is undone or finished by the next.
    """

    PENDING, COMMITTED = "_pending-", "_committed-"

    def __init__(self, spark: SparkSession, folder: str, dormant: int = DORMANT_DAYS, archive: int = ARCHIVE_DAYS):
        self.spark, self.folder, self.dormant, self.archive = spark, folder.rstrip("/"), dormant, archive

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str = "") -> list[str]:
        fs, at = self._fs(), self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _marked(self, kind: str) -> list[str]:
        return [n.removeprefix(kind) for n in self._names() if n.startswith(kind)]

    def _mark(self, name: str, text: str = "") -> None:
        out = self._fs().create(self._path(name), True)
        out.write(text.encode())
        out.close()

    def _given_up(self) -> list[str]:
        out = []
        for run in self._marked(self.COMMITTED):
            out += self._lines(f"{self.COMMITTED}{run}")
        return out

    def _lines(self, name: str) -> list[str]:
        stream = self._fs().open(self._path(name))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return [x for x in text.split("\n") if x]

    def folders(self) -> list[tuple[int, str]]:
        """(day, name) of the folders that count."""
        ignored, undone = set(self._given_up()), {*self._marked(self.PENDING)} - {*self._marked(self.COMMITTED)}
        found = [(int(d.removeprefix("due=")), f"{d}/{o}") for d in self._names() if d.startswith("due=") for o in self._names(d) if o.startswith("run=")]
        return sorted((d, n) for d, n in found if n not in ignored and n.split("run=")[1] not in undone)

    def _recover(self) -> None:
        done = self._marked(self.COMMITTED)
        for run in self._marked(self.PENDING):
            for d in self._names():
                if d.startswith("due=") and run not in done:
                    self._fs().delete(self._path(f"{d}/run={run}"), True)
            self._fs().delete(self._path(f"{self.PENDING}{run}"), False)
        for run in self._marked(self.COMMITTED):
            self._finish(run, self._lines(f"{self.COMMITTED}{run}"))

    def _finish(self, run: str, old: list[str]) -> None:
        for name in old:
            self._fs().delete(self._path(name), True)
        for d in {name.split("/")[0] for name in old}:
            if not self._names(d):
                self._fs().delete(self._path(d), True)
        self._fs().delete(self._path(f"{self.COMMITTED}{run}"), False)

    def _swap(self, rows: DataFrame, now: int, old: list[str]) -> None:
        run = uuid.uuid4().hex
        self._mark(f"{self.PENDING}{run}")
        placed = rows.select(*ENTITY_COLUMNS, due_day(F.col("accessed_at"), F.col("lifecycle"), now, self.dormant, self.archive).alias("due"), F.lit(run).alias("run"))
        placed.repartition("due").write.mode("append").partitionBy("due", "run").parquet(self.folder)
        self._mark(f"{self.COMMITTED}{run}", "\n".join(old))
        self._fs().delete(self._path(f"{self.PENDING}{run}"), False)
        self._finish(run, old)

    def write(self, entities: DataFrame, now: int) -> None:
        """Store a whole table, in place of what is there."""
        self._recover()
        self._swap(entities, now, [n for _, n in self.folders()])

    def _rows(self, names: list[str]) -> DataFrame:
        schema = T.StructType([*ENTITY.fields, T.StructField("due", T.LongType()), T.StructField("run", T.StringType())])
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(*[f"{self.folder}/{n}" for n in names])

    def read(self) -> DataFrame:
        return self._rows([n for _, n in self.folders()]).select(*ENTITY_COLUMNS)

    def refresh(self, now: int, on_disk: DataFrame | None = None) -> DataFrame:
        """``path, old_lifecycle, new_lifecycle`` of what changed; rows that were due move on to their next day.

        With ``on_disk(path)`` every row is looked at, as any file may have gone or come back; without,
        the days up to now's are read.
        """
        self._recover()
        names = [n for d, n in self.folders() if on_disk is not None or NEVER < d <= now // DAY]
        rows, state = self._rows(names), compute_state(F.col("accessed_at"), now, self.dormant, self.archive)
        if on_disk is not None:
            there = on_disk.select("path").distinct().withColumn("_there", F.lit(True))
            rows, state = rows.join(there, "path", "left"), F.when(F.col("_there"), state).otherwise("dead")
        moved = cut(rows.withColumn("old_lifecycle", F.col("lifecycle")).withColumn("lifecycle", state))
        if names:
            self._swap(moved, now, names)
        return moved.where(~F.col("old_lifecycle").eqNullSafe(F.col("lifecycle"))).select("path", "old_lifecycle", F.col("lifecycle").alias("new_lifecycle"))


def histogram(entities: DataFrame) -> DataFrame:
    """``lifecycle, n, bytes``."""
    return entities.groupBy("lifecycle").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: totals and the counts by state as a map."""
    by = histogram(entities).agg(F.sum("n").alias("total_entities"), F.sum("bytes").alias("total_bytes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lifecycle", "n")))).alias("by_lifecycle"))
    return by.crossJoin(relations.agg(F.count("*").alias("total_relations")))  # one row with one row
