"""Metadata filters, point lookups and paging."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.scalars import normal_extension, parse_date
from loam.schema import DAY, LIFECYCLES


@dataclass(frozen=True)
class FindFilter:
    """A conjunction; every bound is strict."""

    state: str | None = None
    extension: str | None = None
    created_after: int | None = None
    modified_after: int | None = None
    larger_than: int | None = None
    limit: int = 0
    offset: int = 0

    def condition(self) -> Column:
        parts = [F.lit(True)]
        if self.state is not None:
            parts.append(F.col("lifecycle") == self.state)
        if self.extension is not None:
            parts.append(F.col("extension") == normal_extension(self.extension))
        if self.created_after is not None:
            parts.append(F.col("created_at") > self.created_after)
        if self.modified_after is not None:
            parts.append(F.col("modified_at") > self.modified_after)
        if self.larger_than is not None:
            parts.append(F.col("size_bytes") > self.larger_than)
        return reduce(lambda a, b: a & b, parts[1:] or parts)

    @property
    def active(self) -> bool:
        return any(x is not None for x in (self.state, self.extension, self.created_after, self.modified_after, self.larger_than))


def build_filter(state=None, extension=None, created_after=None, modified_after=None, modified_within_days=None, larger_than_mb=None, limit=0, offset=0, now: int | None = None) -> FindFilter:
    """From user-facing values: dates as UTC midnight, days before ``now``, sizes in MB."""
    if modified_after is not None:
        after = parse_date(modified_after)
    elif modified_within_days is not None:
        if now is None:
            raise ValueError("modified_within_days needs a time")
        after = now - modified_within_days * DAY
    else:
        after = None
    return FindFilter(state, normal_extension(extension), parse_date(created_after) if created_after is not None else None, after, larger_than_mb * 1_048_576 if larger_than_mb is not None else None, limit, offset)


def by_path(entities: DataFrame, path: str) -> DataFrame:
    return entities.where(F.col("path") == path)


def by_hash(entities: DataFrame, content_hash: str) -> DataFrame:
    return entities.where(F.col("content_hash") == content_hash)


def find(entities: DataFrame, f: FindFilter) -> DataFrame:
    """Latest modification first, path breaks ties; a limit of 0 means 50."""
    return entities.where(f.condition()).orderBy(F.col("modified_at").desc(), "path").offset(f.offset).limit(f.limit or 50)


def count_find(entities: DataFrame, f: FindFilter) -> DataFrame:
    return entities.where(f.condition()).agg(F.count("*").alias("n"))


def list_entities(entities: DataFrame, state: str | None = None, limit: int = 20) -> DataFrame:
    rows = entities.where(F.col("lifecycle") == state) if state else entities
    return rows.orderBy("path").limit(limit)


def list_by_lifecycle(entities: DataFrame, state: str, limit: int = 20) -> DataFrame:
    if state not in LIFECYCLES:
        raise ValueError(f"unknown lifecycle: {state!r}")
    rows = entities.where(F.col("lifecycle") == state).select("path", "name", "lifecycle", "accessed_at", "size_bytes")
    return rows.orderBy(F.col("accessed_at").desc(), "path").limit(limit)


def in_scope(path: Column, scope: str | None) -> Column:
    """The path itself or anything below it, by whole components."""
    if not scope:
        return F.lit(True)
    scope = scope.rstrip("/") or "/"
    return F.lit(True) if scope == "/" else (path == scope) | path.startswith(scope + "/")


def narrowed_scope(scope: str | None, prefix: str | None) -> str | None:
    """The narrower of a session's scope and a request's prefix; an error if they are disjoint."""
    if not prefix:
        return scope
    prefix = prefix.rstrip("/") or "/"
    if not scope or prefix == scope or prefix.startswith(scope.rstrip("/") + "/"):
        return prefix
    if scope.startswith(prefix.rstrip("/") + "/"):
        return scope
    raise PermissionError(f"{prefix} is outside the scope {scope}")


def with_prefix(entities: DataFrame, prefix: str) -> DataFrame:
    """Entities whose path starts with ``prefix``, in the middle of a name too."""
    return entities.where(F.col("path").startswith(prefix))


def indexer_source(entities: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """Entities that can be indexed: hashed and not dead, in any of the scopes."""
    ok = F.col("content_hash").isNotNull() & (F.col("lifecycle") != "dead")
    if scopes:
        ok = ok & reduce(lambda a, b: a | b, [in_scope(F.col("path"), s) for s in scopes])
    return entities.where(ok)


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, id``: the root with the most components that is the path or above it.

    Each path lists its ancestors, so the match is an equi-join and grows with the data, not with
    paths times roots.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    chain = paths.select("path").distinct().select("path", F.posexplode(above).alias("depth", "root"))
    met = chain.join(roots.select(F.regexp_replace("root", r"/+$", "").alias("root"), "id"), "root")
    return met.groupBy("path").agg(F.max_by("id", F.struct("depth", "id")).alias("id"))
