"""Schemas of the model's tables, and the engine's constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the model: thresholds, caps and weights.
DAY = 86_400
NOW = 1_706_745_600  # 2024-02-01T00:00:00Z; queries take the time as a parameter
DORMANT_DAYS = 30
ARCHIVE_DAYS = 90
MAX_FILE_BYTES = 104_857_600
MAX_TEXT_CHARS = 32_000
FTS_CHARS = 4_000
PREVIEW_CHARS = 500
FALLBACK_TEXT_BYTES = 1_000_000
VECTOR_WEIGHT = 0.7
FTS_WEIGHT = 0.3
MAX_GRAPH_DEPTH = 3
RENAME_WINDOW_SECONDS = 5
LIFECYCLES = ("born", "active", "dormant", "archived", "dead")
EVENTS = ("created", "modified", "lifecycle", "renamed", "deleted")

ENTITY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("modified_at", T.LongType()),
        T.StructField("accessed_at", T.LongType()),
        T.StructField("lifecycle", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("git_author", T.StringType()),
    ]
)
RELATION = T.StructType([T.StructField("from_path", T.StringType()), T.StructField("to_path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("created_at", T.LongType())])
HISTORY = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("old_lifecycle", T.StringType()),
        T.StructField("new_lifecycle", T.StringType()),
        T.StructField("old_path", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("recorded_at", T.LongType()),
        T.StructField("seq", T.IntegerType()),
    ]
)
VECTOR = T.StructType([T.StructField("path", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("text_preview", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("indexed_at", T.LongType())])
ENTITY_COLUMNS = [f.name for f in ENTITY]
