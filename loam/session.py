"""Session helpers shared by every part of the library."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "loam", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library expects; keyword names use ``__`` for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: the cluster's, or a local one where a local session sets none."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="loam-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own what is written within by ``cut`` and under ``scratch_path``: it is deleted at the end.

    So the results must have been written or collected by then. Scopes nest; without one, the tables
    stay until whoever owns the shared folder clears it.
    """
    own: list[str] = []
    token = _OWNED.set(own)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for at in own:
            delete_path(spark, at)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which the innermost ``scratch`` owns."""
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (own := _OWNED.get()) is not None:
        own.append(at)
    return at


def delete_path(spark: SparkSession, at: str) -> None:
    """Delete a file or folder, through the file system that its name asks for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: it is written to the shared folder and read again.

    Unlike a checkpoint, a written table is computed once and has the size of its files as statistics;
    a checkpoint keeps the estimate of its plan, which joins multiply round after round. The innermost
    ``scratch`` owns the table.
    """
    spark = df.sparkSession
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names that differ by case alone can't be written
    if "void" in plain.schema.simpleString():
        return df.checkpoint(eager=True)
    at = scratch_path(spark, "cut")
    plain.write.option("compression", "snappy").parquet(at)
    return spark.read.schema(plain.schema).parquet(at).toDF(*df.columns)


def stored(df: DataFrame) -> DataFrame:
    """``df`` if it is read from files with nothing but columns and rows picked, else a cut of it.

    For tables that a loop reads many times: a stored one is not copied.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steps = {line.lstrip(" +-:").split(" ")[0] for line in plan.splitlines() if line.strip()}
    return df if steps <= {"Project", "Filter", "Relation"} else cut(df)


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
