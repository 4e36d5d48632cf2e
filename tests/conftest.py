import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def entity_rows(spark):
    """Entity rows from short tuples: path, hash, lifecycle, and what else is given by name."""
    from loam.schema import ENTITY

    def make(*rows):
        out = []
        for r in rows:
            path, h, life, more = (*r, *(None, "active", {})[len(r) - 1 :])[:4] if len(r) < 4 else r
            name = path.rsplit("/", 1)[-1]
            base = {"id": f"id:{path}", "path": path, "name": name, "extension": name.rsplit(".", 1)[-1] if "." in name[1:] else None, "size_bytes": 42, "created_at": 1_000_000, "modified_at": 1_000_000, "accessed_at": 1_000_000, "lifecycle": life, "content_hash": h, "summary": None, "git_author": None}
            base.update(more)
            out.append(tuple(base[f.name] for f in ENTITY))
        return spark.createDataFrame(out, ENTITY)

    return make
