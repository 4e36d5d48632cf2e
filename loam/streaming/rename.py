"""The rename-aware change feed: removes wait for a create with the same content.

Events are ``ts`` (seconds), ``event_id``, ``action`` (create, modify, remove, rename_both,
rename_from, rename_to, access), ``path``, ``new_path`` and ``content_hash``. Actions come out as
``action, path, old_path, content_hash, ts``: rename, upsert, delete, touch, cancelled.

A remove is held by its hash. A create within ``window`` seconds (inclusive) whose hash has exactly
one held remove of another path is a rename; held removes of the same path are cancelled; otherwise
it is an upsert. What has waited longer is a delete. Removes without a hash, or with one that only
stands for a size, are deletes at once.

The stream is one query of two stateful operators. The first is keyed by path and keeps its last
hash, so that a remove, whose file is gone, still has one; it starts with the hashes of the entity
table. The second is keyed by hash and holds removes. Nothing is read twice. An event that comes later
than the watermark isn't dropped: it is given out as a ``late`` action as well, and only that if its
path has seen something newer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from loam.schema import DAY, RENAME_WINDOW_SECONDS
from loam.session import cut, shuffle_width

CELL_EVENTS = 100_000

ACTIONS = "action string, path string, old_path string, content_hash string, ts long"


class Tracker:
    """The held removes of one hash."""

    def __init__(self, window: int = RENAME_WINDOW_SECONDS, held: list[tuple[str, int]] = ()):
        self.window, self.held = window, list(held)

    def expire(self, now: int) -> list[tuple[str, int]]:
        """Removes that have waited longer than the window, as (path, time)."""
        out = [h for h in self.held if now - h[1] > self.window]
        self.held = [h for h in self.held if now - h[1] <= self.window]
        return out

    def remove(self, path: str, ts: int) -> None:
        self.held.append((path, ts))

    def create(self, path: str) -> str | None:
        """The old path if the create is a rename. Removes of the same path are cancelled."""
        self.held = [h for h in self.held if h[0] != path]
        return self.held.pop()[0] if len(self.held) == 1 else None


def with_hash(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Removes without a hash take the last one that is known of their path: the file is gone.

    That is the hash of the path's last earlier event that has one, else the stored entity's. A
    path's events are sorted once, however many there are.
    """
    gone = F.col("action").isin("remove", "rename_from")
    before = Window.partitionBy("path").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    made = F.last(F.when(~gone, F.col("content_hash")), ignorenulls=True).over(before)
    both = events.withColumn("_m", made).join(entities.select("path", F.col("content_hash").alias("_h")), "path", "left")
    return both.withColumn("content_hash", F.when(gone, F.coalesce("content_hash", "_m", "_h")).otherwise(F.col("content_hash"))).select(*events.columns)


def plain(h: Column) -> Column:
    """Hashes that can be matched."""
    return h.isNotNull() & ~h.startswith("size:")


def direct_actions(events: DataFrame) -> DataFrame:
    """Actions of the events that never wait: matched renames, accesses and what has no usable hash."""
    a = F.col("action")
    action = F.when(a == "rename_both", "rename").when(a == "access", "touch").when(a.isin("remove", "rename_from"), "delete").otherwise("upsert")
    rows = events.where(a.isin("rename_both", "access") | (a.isin("remove", "rename_from", "create", "modify", "rename_to") & ~F.coalesce(plain(F.col("content_hash")), F.lit(False))))
    both = F.col("action") == "rename_both"
    return rows.select(action.alias("action"), F.when(both, F.col("new_path")).otherwise(F.col("path")).alias("path"), F.when(both, F.col("path")).alias("old_path"), "content_hash", "ts")


def waiting(events: DataFrame) -> DataFrame:
    """Events that go through the tracker of their hash."""
    return events.where(F.col("action").isin("remove", "rename_from", "create", "modify", "rename_to") & F.coalesce(plain(F.col("content_hash")), F.lit(False)))


def _step(tracker: Tracker, h: str, action: str, path: str, ts: int) -> list[tuple]:
    out = [("delete", p, None, h, t) for p, t in tracker.expire(ts)]
    if action in ("remove", "rename_from"):
        tracker.remove(path, ts)
        return out
    before = len(tracker.held)
    old = tracker.create(path)
    if old is not None:
        return [*out, ("rename", path, old, h, ts)]
    cancelled = before > len(tracker.held)
    return [*out, ("cancelled", path, None, h, ts), ("upsert", path, None, h, ts)] if cancelled else [*out, ("upsert", path, None, h, ts)]


def sessions(events: DataFrame, window: int = RENAME_WINDOW_SECONDS) -> DataFrame:
    """Events with ``session``: a hash's events part where more than the window passes, as nothing is held then."""
    order = Window.partitionBy("content_hash").orderBy("ts", "event_id")
    apart = F.col("ts") - F.lag("ts").over(order) > window
    return events.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("long")).withColumn("session", F.sum("_new").over(order)).drop("_new")


def replay(events: DataFrame, until: int | None = None, window: int = RENAME_WINDOW_SECONDS) -> DataFrame:
    """The batch form: all actions of a set of events, as if the feed ran on to ``until`` (or for ever).

    A hash's events are handled in order of time and id, session by session. Sessions are dealt to
    cells of some ``CELL_EVENTS``, so a task holds its cell and at most what happens to one content
    without a pause of the window's length.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        rows = pdf.sort_values(["content_hash", "session", "ts", "event_id"])
        own, tracker = None, Tracker(window)

        def leave() -> None:
            left = tracker.expire(until) if until is not None else tracker.held
            out.extend(("delete", p, None, own[0], t) for p, t in left)

        for h, session, action, path, ts in zip(rows["content_hash"], rows["session"], rows["action"], rows["path"], rows["ts"]):
            if own != (h, session):
                leave()
                own, tracker = (h, session), Tracker(window)
            out.extend(_step(tracker, h, action, path, int(ts)))
        leave()
        return pd.DataFrame(out, columns=["action", "path", "old_path", "content_hash", "ts"])

    rows = cut(sessions(waiting(events).select("content_hash", "ts", "event_id", "action", "path"), window))
    cells = max(shuffle_width(events.sparkSession), rows.count() // CELL_EVENTS + 1)
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("content_hash", "session"), F.lit(cells)))
    return dealt.groupBy("cell").applyInPandas(run, ACTIONS).unionByName(direct_actions(events))


EVENTS = "ts long, event_id long, action string, path string, new_path string, content_hash string"
HASHED = EVENTS + ", late boolean, stale boolean"
GONE = ("remove", "rename_from")
LEARN = "learn"  # tells a path its hash and does nothing else


class PathHashes(StatefulProcessor):
    """Keyed by path: its last hash, for removes. A path that is gone is forgotten after ``memory`` seconds."""

    def __init__(self, memory: int = DAY):
        self.memory = memory

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string, made long, seen long, gone boolean")

    def _load(self) -> tuple:
        return tuple(self.last.get()) if self.last.exists() else (None, -1, -1, False)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((initialState["content_hash"].iloc[0], -1, -1, False))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        h, made, seen, gone = self._load()
        mark = timerValues.getCurrentWatermarkInMs()
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out: list[tuple] = []
        for ts, event_id, action, path, new_path, own in zip(*(events[c] for c in ("ts", "event_id", "action", "path", "new_path", "content_hash"))):
            ts, own = int(ts), own if isinstance(own, str) else None
            late, stale = ts * 1000 < mark, ts * 1000 < mark and ts < seen
            if action in GONE:
                own = own or (h if made <= ts else None)
            elif own is not None and ts >= made:
                h, made = own, ts
            if action != LEARN:
                out.append((ts, int(event_id), action, path, new_path if isinstance(new_path, str) else None, own, late, stale))
            if ts >= seen and action != "access":
                seen, gone = ts, action in GONE or action == "rename_both"
        self.last.update((h, made, seen, gone))
        if gone:
            self.handle.registerTimer((seen + self.memory) * 1000)
        yield pd.DataFrame(out, columns=["ts", "event_id", "action", "path", "new_path", "content_hash", "late", "stale"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, seen, gone = self._load()
        if gone and (seen + self.memory) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame([], columns=["ts", "event_id", "action", "path", "new_path", "content_hash", "late", "stale"])

    def close(self) -> None:
        pass


class RenameProcessor(StatefulProcessor):
    """Keyed by hash: held removes are list state, expiry is an event-time timer.

    Events that never wait come under keys of their own and leave as direct actions at once.
    """

    def __init__(self, window: int = RENAME_WINDOW_SECONDS):
        self.window = window

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "path string, ts long")

    def _load(self) -> Tracker:
        return Tracker(self.window, [(r[0], r[1]) for r in self.held.get()] if self.held.exists() else [])

    def _store(self, tracker: Tracker) -> None:
        if tracker.held:
            self.held.put(tracker.held)
        elif self.held.exists():
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tracker = self._load()
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out: list[tuple] = []
        for action, path, new_path, h, ts, late, stale, waits in zip(*(events[c] for c in ("action", "path", "new_path", "content_hash", "ts", "late", "stale", "waits"))):
            ts, h = int(ts), h if isinstance(h, str) else None
            if late:
                out.append(("late", path, None, h, ts))
            if stale:
                continue
            if not waits:
                out.append(("rename", new_path, path, h, ts) if action == "rename_both" else ("touch" if action == "access" else "delete" if action in GONE else "upsert", path, None, h, ts))
                continue
            out += _step(tracker, h, action, path, ts)
            if action in GONE:
                self.handle.registerTimer((ts + self.window) * 1000 + 1)
        self._store(tracker)
        yield pd.DataFrame(out, columns=["action", "path", "old_path", "content_hash", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracker = self._load()
        gone = tracker.expire(-(-expiredTimerInfo.getExpiryTimeInMs() // 1000))
        self._store(tracker)
        yield pd.DataFrame([("delete", p, None, key[0], t) for p, t in gone], columns=["action", "path", "old_path", "content_hash", "ts"])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


KNOWN_ACTIONS = ("create", "modify", "remove", "rename_both", "rename_from", "rename_to", "access")


def stream(events: DataFrame, entities: DataFrame | None = None, window: int = RENAME_WINDOW_SECONDS, delay: str = "5 seconds", memory: int = DAY) -> DataFrame:
    """All actions of a stream of events, in one query.

    The watermark is ``delay`` behind the latest event. It drives the timers only: its column doesn't
    reach the operators, so they see late events and give them out as ``late``. ``entities`` are
    the hashes to start with; a ``rename_both`` that has a hash tells it to the new path.
    """
    columns = [c.split()[0] for c in EVENTS.split(", ")]
    timed = events.where(F.col("action").isin(*KNOWN_ACTIONS)).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay)
    told = (F.col("action") == "rename_both") & F.col("content_hash").isNotNull() & F.col("new_path").isNotNull()
    row = lambda action, path: F.struct(F.col("ts").cast("long").alias("ts"), F.col("event_id").cast("long").alias("event_id"), action.alias("action"), path.alias("path"), "new_path", "content_hash")
    both = F.array_compact(F.array(row(F.col("action"), F.col("path")), F.when(told, row(F.lit(LEARN), F.col("new_path")))))
    rows = timed.select(F.explode(both).alias("e")).select(*[f"e.{c}" for c in columns])
    first = entities.where("content_hash is not null").select("path", "content_hash").groupBy("path") if entities is not None else None
    hashed = rows.groupBy("path").transformWithStateInPandas(PathHashes(memory), HASHED, "Append", "EventTime", first)
    waits = F.col("action").isin(*GONE, "create", "modify", "rename_to") & F.coalesce(plain(F.col("content_hash")), F.lit(False))
    keyed = hashed.withColumn("waits", waits).withColumn("key", F.when(F.col("waits"), F.col("content_hash")).otherwise(F.concat(F.lit("path:"), "path")))
    return keyed.groupBy("key").transformWithStateInPandas(RenameProcessor(window), ACTIONS, "Append", "EventTime")


def late(actions: DataFrame) -> DataFrame:
    """The events that came later than the watermark, as ``path, content_hash, ts``."""
    return actions.where("action = 'late'").select("path", "content_hash", "ts")


class Watch:
    """A running feed; ``log`` has a line for each batch."""

    def __init__(self, query, log: list[dict]):
        self.query, self.log = query, log

    def stop(self) -> None:
        self.query.stop()

    def drain(self, timeout: int | None = None) -> None:
        """Wait until it has handled what is there (for ``availableNow`` triggers, and tests)."""
        self.query.awaitTermination(timeout)


LOG_LINES = 1000


def watch(spark: SparkSession, folder: str, schema: str, entities, sink, checkpoint: str, trigger: dict | None = None, window: int = RENAME_WINDOW_SECONDS, memory: int = DAY, log: str | None = None) -> Watch:
    """Start the feed over a folder of change files; ``sink(actions, epoch)`` merges each batch.

    ``entities`` is the current table, or a function that returns it: the hashes that removes find
    until the feed itself has seen newer ones. A restart goes on with what its checkpoint knows. A
    batch's counts by action go to ``Watch.log`` (its last ``LOG_LINES`` lines), and to the folder
    ``log`` as JSON if there is one.
    """
    use_state_store(spark)
    lines: list[dict] = []

    def merge(actions: DataFrame, epoch: int) -> None:
        own = cut(actions)  # the sink may read it several times; the operators run once
        sink(own, epoch)
        counts = own.groupBy("action").agg(F.count("*").alias("n"), F.max("ts").alias("upto"))
        known = counts.collect()  # a handful of actions
        lines.append({"epoch": epoch, "upto": max((r["upto"] for r in known), default=None), **{r["action"]: r["n"] for r in sorted(known, key=lambda r: r["action"])}})
        del lines[:-LOG_LINES]
        if log:  # a batch that is run again replaces its own line
            counts.withColumn("epoch", F.lit(epoch)).coalesce(1).write.mode("overwrite").json(f"{log.rstrip('/')}/epoch={epoch:09d}")

    events = spark.readStream.schema(schema).parquet(folder)
    actions = stream(events, entities() if callable(entities) else entities, window, memory=memory)
    query = actions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "2 seconds"})).start()
    return Watch(query, lines)


def every(spark: SparkSession, job, interval: str = "6 hours", checkpoint: str | None = None):
    """Run ``job(epoch)`` at an interval: lifecycle refreshes and index runs."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, epoch: job(epoch)).trigger(processingTime=interval)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def running(spark: SparkSession) -> list[dict]:
    """The active feeds, with their last progress."""
    return [{"id": str(q.id), "name": q.name, "status": q.status, "progress": q.lastProgress} for q in spark.streams.active]


def stop(spark: SparkSession, prefix: str) -> int:
    """Stop the feeds whose id or name starts with ``prefix``."""
    found = [q for q in spark.streams.active if str(q.id).startswith(prefix) or (q.name or "").startswith(prefix)]
    for q in found:
        q.stop()
    return len(found)
