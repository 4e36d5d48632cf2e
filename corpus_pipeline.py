"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, secret scans, SentencePiece.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before kept and
returns a DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.

1. ``language_id`` drops documents whose language is ``und`` or whose language has less than
   ``LANGUAGE_SHARE`` of the words' posterior; the others get the predicted language as ``lang``.
2. ``near_duplicates`` keeps the smallest id of each component of documents that share 80% of their
   five-word shingles.
3. ``decontamination`` drops documents that contain 80% of a benchmark item's five-word shingles.
4. ``secrets`` replaces every secret by ``[SECRET]`` and sets ``n_chars`` anew.
5. ``tokens`` encodes with the public 32k merge-type vocabulary, begin and end ids included.

Rows with null texts or texts without letters are ``und`` and go in stage 1; null ids can't be told
apart, so stage 2 keeps them all; of rows that repeat an id, stage 2 keeps each different text once if
the id stays; ties go to the smallest id; texts of any length are read whole in every stage; empty
tables pass through every stage; columns other than those of ``documents`` are dropped in stage 1.

``run`` removes what a stage's operator has written on its way when the stage's table is written, and
that table once the next one is; the last one's stays, as the result is read from it.

Whole texts go to Python workers and back, and both sides hold a few batches of them at once. So every
stage has the session send at most ``BATCH_ROWS`` rows in an Arrow batch from then on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import decontaminate, jaccard_join, language_id, pieces, secrets
from loam.llm.registry import piece_model
from loam.session import delete_path, ensure_checkpoint_dir, scratch, table

LANGUAGE_SHARE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after the session's Arrow batches have been bounded; a lower bound of the session's own stays."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH, "0")) <= BATCH_ROWS:  # 0 and less: unbounded
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    carried = tuple(c for c in COLUMNS if c != "lang")
    found = language_id.predict(docs, model, carried)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.dedup(docs, 5, 80, 100).select(*COLUMNS)


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


@in_small_batches
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digest(docs, piece_model(), keep=("lang", "source", "n_chars"))


STAGES = [
    ("language_id", keep_languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: The language model can't be expressed in SQL, so neither can the rows that follow from it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder."""
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what the stage's operator writes on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            delete_path(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
