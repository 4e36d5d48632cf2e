"""Trees of files, listed, hashed and read by the executors.

``listing`` walks a tree breadth first: each task takes some folders of the frontier, lists them and
what lies below until it has met ``TASK_ENTRIES`` names, and gives back the folders that it didn't
get to; those are dealt anew in the next round. So a flat, a deep and a lopsided tree all spread over
the tasks, and the driver holds the root's name and a count. Folders whose name is among ``skip``
are not entered. Symbolic links are not followed.

A listing has no contents. ``with_hash`` adds digests as a column that reads a file in blocks when it
is used and not at all when it isn't, so counts, filters and times read no bytes; filters on other
columns come first. ``with_content`` reads whole files, a bounded number of bytes at a time.

The tree must be visible to all executors under the same path: a shared mount, or a URI that Arrow's
file systems reach (``file:``, ``hdfs:``, ``s3:``, ``gs:``). Outside of local folders times of access
and creation aren't known, and the modification stands in for them.

Edge cases: a folder or file that can't be read, or is gone by the time it is, is a row with an
``error`` and what is known of it; an empty tree gives no rows; a root that is a file is one row; names
that aren't UTF-8 keep their bytes as surrogate escapes replaced by ``?``.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.schema import MAX_FILE_BYTES
from loam.session import cut, shuffle_width

TASK_ENTRIES = 20_000
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 16 << 20
FOUND = "path string, folder boolean, created_at long, modified_at long, accessed_at long, size_bytes long, error string"
_KINDS = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_NAMES = [f.split()[0] for f in FOUND.split(", ")]


def local_path(path: str) -> str | None:
    """The path of a local file, without its scheme; None for other file systems."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _remote(path: str):
    """(file system, path in it, what to put before its paths)."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner.lstrip("/"))] if path.endswith(inner.lstrip("/")) else path.split("://")[0] + "://"


def _local_entries(folder: str) -> Iterator[tuple]:
    """Rows of what a local folder holds, or of the file that it is."""

    def row(path: str, s: os.stat_result) -> tuple:
        return (path, stat.S_ISDIR(s.st_mode), int(s.st_ctime), int(s.st_mtime), int(s.st_atime), s.st_size, None)

    own = os.lstat(folder)
    if stat.S_ISREG(own.st_mode):
        yield row(folder, own)
        return
    with os.scandir(folder) as found:
        for e in found:
            try:
                s = e.stat(follow_symlinks=False)
            except OSError as x:  # gone since it was listed
                yield (e.path, False, None, None, None, None, str(x))
                continue
            if stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode):
                yield row(e.path, s)


def _remote_entries(folder: str) -> Iterator[tuple]:
    from pyarrow import fs

    system, inner, before = _remote(folder)
    own = system.get_file_info(inner)
    for i in [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner)):
        at = i.mtime_ns // 1_000_000_000 if i.mtime_ns is not None else None
        if i.type in (fs.FileType.File, fs.FileType.Directory):
            yield (before + i.path.lstrip("/"), i.type == fs.FileType.Directory, at, at, at, i.size or 0, None)


def entries(folder: str) -> Iterator[tuple]:
    return _local_entries(local_path(folder)) if local_path(folder) is not None else _remote_entries(folder)


def _descend(skip: frozenset[str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: deque[str] = deque()
        out: list[tuple] = []
        met = 0

        def batch():
            clean = [(r[0].encode("utf-8", "replace").decode(), *r[1:]) for r in out]
            rows = pa.record_batch([pa.array([r[i] for r in clean], k) for i, k in enumerate(_KINDS)], names=_NAMES)
            out.clear()
            return rows

        for b in batches:
            todo.extend(b.column(0).to_pylist())
        while todo:
            folder = todo.popleft()
            if met >= most:  # left for another task of the next round
                out.append((folder, True, None, None, None, None, None))
            else:
                try:
                    for r in entries(folder):
                        met += 1
                        if not r[1]:
                            out.append(r)
                        elif os.path.basename(r[0]) not in skip:
                            todo.append(r[0])
                        if len(out) >= 10_000:
                            yield batch()
                except OSError as x:
                    out.append((folder, False, None, None, None, None, str(x)))
            if len(out) >= 10_000:
                yield batch()
        yield batch()

    return run


def listing(spark: SparkSession, root: str, skip: tuple[str, ...] = (), task_entries: int = TASK_ENTRIES) -> DataFrame:
    """``path, created_at, modified_at, accessed_at, size_bytes, error`` of all files below ``root``."""
    local = local_path(root)
    top = root.rstrip("/") if local is None else os.path.realpath(local)
    frontier, found = spark.createDataFrame([(top,)], "path string"), None
    while True:
        width = shuffle_width(spark)
        step = cut(frontier.repartition(width).mapInArrow(_descend(frozenset(skip), task_entries), FOUND))
        files = step.where(~F.col("folder")).drop("folder")
        found = files if found is None else found.unionByName(files)
        frontier = step.where("folder").select("path")
        if frontier.isEmpty():
            return found


def _opened(path: str):
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    system, inner, _ = _remote(path)
    return system.open_input_stream(inner)


def _digest(path: str) -> str | None:
    try:
        h = hashlib.sha256()
        with _opened(path) as f:
            while block := f.read(BLOCK_BYTES):
                h.update(block)
        return h.hexdigest()
    except OSError:
        return None


@F.pandas_udf(T.StringType())
def _digests(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for p in paths:
        yield p.map(lambda x: None if x is None else _digest(x))


def file_hash(path: Column, size: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """SHA-256 of a file, read in blocks where the column is used; of a larger one than ``max_bytes`` its size."""
    small = F.when(size <= max_bytes, path)
    return F.when(size > max_bytes, F.concat(F.lit("size:"), size.cast("string"))).otherwise(_digests(small))


def with_hash(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """A listing with ``content_hash``; null where a file can't be read."""
    return files.withColumn("content_hash", file_hash(F.col("path"), F.col("size_bytes"), max_bytes))


def with_content(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """A listing with ``content``, null for files above ``max_bytes``; what can't be read has an ``error``.

    Rows pass in batches of about ``BATCH_BYTES`` of content, so a task holds one batch and one file.
    """
    names = [*files.columns, "content"]
    at, size, error = files.columns.index("path"), files.columns.index("size_bytes"), files.columns.index("error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(b, first, rows):
            part = b.slice(first, len(rows))
            columns = [pa.array([r[1] for r in rows], pa.string()) if i == error else part.column(i) for i in range(part.num_columns)]
            return pa.record_batch([*columns, pa.array([r[0] for r in rows], pa.binary())], names=names)

        for b in batches:
            first, held, rows = 0, 0, []
            for path, n, known in zip(b.column(at).to_pylist(), b.column(size).to_pylist(), b.column(error).to_pylist()):
                data = None
                if known is None and n is not None and n <= max_bytes:
                    try:
                        with _opened(path) as f:
                            data = f.read()
                    except OSError as x:
                        known = str(x)
                rows.append((data, known))
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield packed(b, first, rows)
                    first, held, rows = first + len(rows), 0, []
            if rows:
                yield packed(b, first, rows)

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), "content binary"]
    return files.mapInArrow(run, ", ".join(fields))
