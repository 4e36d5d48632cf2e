"""Full-text, vector and hybrid search with explanations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.scalars import preview
from loam.operators.find import in_scope
from loam.operators.text_index import TextIndex
from loam.schema import FTS_CHARS, FTS_WEIGHT, PREVIEW_CHARS, VECTOR_WEIGHT
from loam.session import cut

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _fold_table() -> tuple[str, str]:
    """Letters that decompose into a letter and marks, and that letter; then the marks, which go."""
    pairs, marks = {}, []
    for c in map(chr, range(0xC0, 0x3000)):
        if unicodedata.combining(c):
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs) + "".join(marks), "".join(pairs.values())


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold_marks(text: Column) -> Column:
    """Without the marks of letters, precomposed or not, below U+3000; ASCII texts pass as they are."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, _FOLD_FROM, _FOLD_TO))


def folded(text: Column) -> Column:
    """Folded and lower-cased: what terms are looked for in."""
    return F.lower(fold_marks(F.coalesce(text, F.lit(""))))


def tokens_of(text: Column) -> Column:
    """Folded, lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(fold_marks(text)), r"[^\p{L}\p{N}]+"), "")


def sanitize(query: str) -> str:
    """Letters, digits and ``_ - / .``; everything else parts words."""
    return " ".join("".join(c if c.isalnum() or c in "_-/." else " " for c in query).split())


def sanitized(query: Column) -> Column:
    """The same for a column of queries."""
    return F.trim(F.regexp_replace(query, r"[^\p{L}\p{N}_\-/.]+", " "))


def query_phrases(query: str) -> list[list[str]]:
    """Phrases that must all match: words, or words joined by ``_ - / .``."""
    folded = "".join(c for c in unicodedata.normalize("NFD", sanitize(query)) if not unicodedata.combining(c)).lower()
    phrases = [[t for t in re.split(r"[_\-/.]+", w) if t] for w in folded.split()]
    return [p for p in phrases if p]


def fts_rows(docs: DataFrame) -> DataFrame:
    """``path, name, content``: the text cut to what the index holds."""
    return docs.select("path", "name", F.substring("content", 1, FTS_CHARS).alias("content"))


def _phrase_pattern(phrase: list[str]) -> str:
    """A pattern with one match for every place where the phrase's words stand in a row, overlapping or not."""
    gap, stop = r"[^\p{L}\p{N}]+", r"(?![\p{L}\p{N}])"
    head, rest = re.escape(phrase[0]), gap.join(map(re.escape, phrase[1:]))
    return rf"(?<![\p{{L}}\p{{N}}]){head}" + (rf"(?={gap}{rest}{stop})" if rest else stop)


def _bm25(tf: Column, n: Column, dl: Column, total: Column, avgdl: Column) -> Column:
    idf = F.log((total - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def fts_match(texts: DataFrame, query: str) -> DataFrame:
    """``path, rank`` of the rows that match all phrases; the rank is BM25, negative, better first.

    For a table that is searched once: texts are read and folded once, words and the query's terms
    are counted in them, and a few numbers a row are kept for both the statistics and the matches.
    ``TextIndex`` is for many queries. Names and contents are one stream of words for lengths and
    counts; a phrase must lie in one of them.
    """
    terms = list({" ".join(p): p for p in query_phrases(query)}.values())
    if not terms:
        return texts.select("path", F.lit(0.0).alias("rank")).where(F.lit(False))
    t = texts.select("path", folded(F.col("name")).alias("n"), folded(F.col("content")).alias("c"))

    def count(pattern: str) -> Column:
        return F.regexp_count("n", F.lit(pattern)) + F.regexp_count("c", F.lit(pattern))

    def hits(phrase: list[str]) -> Column:  # texts without the first word's letters aren't matched word by word
        near = F.contains("n", F.lit(phrase[0])) | F.contains("c", F.lit(phrase[0]))
        return F.when(near, count(_phrase_pattern(phrase))).otherwise(0)

    counted = cut(t.select("path", count(r"[\p{L}\p{N}]+").cast("long").alias("dl"), *[hits(x).cast("long").alias(f"tf{i}") for i, x in enumerate(terms)]))
    stats = counted.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    matched = counted.where(reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
    both = matched.crossJoin(F.broadcast(stats))  # one row of statistics
    parts = [_bm25(F.col(f"tf{i}"), F.col(f"n{i}"), F.col("dl"), F.col("N"), F.col("avgdl")) for i in range(len(terms))]
    return both.select("path", (-reduce(lambda a, b: a + b, parts)).alias("rank"))


def fts_search(texts: DataFrame | TextIndex, query: str, limit: int = 10, scope: str | None = None) -> DataFrame:
    """``path, rank``: the best matches in a scope, of a table that is scanned or of a stored index."""
    if isinstance(texts, TextIndex):
        return texts.top(query, limit, scope)
    return fts_match(texts, query).where(in_scope(F.col("path"), scope)).orderBy("rank", "path").limit(limit)


def fts_score(rank: Column, norm: str = "parity") -> Column:
    """``parity``: 1 / (1 + max(rank, 0)), which is 1 for every match; ``abs``: 1 / (1 + |rank|)."""
    return 1 / (1 + (F.greatest(rank, F.lit(0.0)) if norm == "parity" else F.abs(rank)))


def distance(vector: Column, query: list[float], metric: str = "l2sq") -> Column:
    """Squared Euclidean or cosine distance, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in query])
    zero = F.lit(0.0)
    if metric == "l2sq":
        return F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), zero, lambda s, x: s + x)
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), zero, lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - dot / (norm * sum(x * x for x in query) ** 0.5)


def knn(vectors: DataFrame, query: list[float], limit: int = 10, scope: str | None = None, metric: str = "l2sq", exclude: str | None = None) -> DataFrame:
    """``path, distance, score``: the exact nearest rows; the scope filters before the ranking."""
    rows = vectors.where(F.col("vector").isNotNull() & in_scope(F.col("path"), scope))
    if exclude is not None:
        rows = rows.where(F.col("path") != exclude)
    d = rows.select("path", distance(F.col("vector"), query, metric).alias("distance"))
    return d.orderBy("distance", "path").limit(limit).withColumn("score", 1 - F.col("distance"))


def knn_like(vectors: DataFrame, path: str, limit: int = 10, scope: str | None = None, metric: str = "l2sq") -> DataFrame:
    """The rows nearest to a stored path's vector, itself left out; empty for an unknown path."""
    own = vectors.where(F.col("path") == path).select("vector").head(1)
    if not own:
        return vectors.select("path", F.lit(0.0).alias("distance"), F.lit(0.0).alias("score")).where(F.lit(False))
    return knn(vectors, [float(x) for x in own[0]["vector"]], limit, scope, metric, exclude=path)


def embed_hashed(text: str, dim: int = 64) -> list[float]:
    """The default embedder: signed feature hashing of words, unit length. A model may take its place."""
    import hashlib

    out = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out[h % dim] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in out) ** 0.5
    return [x / n for x in out] if n else out


def vector_rows(rows: DataFrame, embed=embed_hashed, at: int = 0, load=None) -> DataFrame:
    """Vector-table rows of ``path, content_hash, text``; texts are embedded in Arrow batches.

    ``load()``, if given, makes the embedder; it runs once in each task, before the first batch, so a
    model is read there and not on the driver.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = load() if load else embed
        for texts in batches:
            yield texts.map(lambda t: own(t or ""))

    return rows.select("path", "content_hash", preview(F.col("text"), PREVIEW_CHARS).alias("text_preview"), run("text").alias("vector"), F.lit(at).cast("long").alias("indexed_at"))


def candidate_limit(limit: int, offset: int = 0, filtered: bool = False) -> int:
    return (12 if filtered else 4) * max(limit + offset, 1)


def fused(vector_hits: DataFrame | None, fts_hits: DataFrame | None, mode: str = "hybrid", norm: str = "parity") -> DataFrame:
    """``path, score, vector_score, fts_rank, fts_score, source`` of both channels' hits.

    A channel's weight is 0.7 (vectors) or 0.3 (text) in hybrid mode, else 1.
    """
    some = vector_hits if vector_hits is not None else fts_hits
    none = some.sparkSession.createDataFrame([], "path string, score double, rank double")
    v = (vector_hits if vector_hits is not None and mode != "fts" else none).select("path", F.col("score").alias("vector_score"))
    f = (fts_hits if fts_hits is not None and mode != "vector" else none).select("path", F.col("rank").alias("fts_rank"))
    both = v.join(f, "path", "full_outer").withColumn("fts_score", F.when(F.col("fts_rank").isNotNull(), fts_score(F.col("fts_rank"), norm)))
    wv, wf = (VECTOR_WEIGHT, FTS_WEIGHT) if mode == "hybrid" else (1.0, 1.0)
    score = F.coalesce(F.col("vector_score") * wv, F.lit(0.0)) + F.coalesce(F.col("fts_score") * wf, F.lit(0.0))
    source = F.when(F.col("vector_score").isNotNull() & F.col("fts_rank").isNotNull(), "hybrid").when(F.col("vector_score").isNotNull(), "vector").when(F.col("fts_rank").isNotNull(), "fts").otherwise("-")
    return both.withColumn("score", score).withColumn("source", source)


def ranked(hits: DataFrame, limit: int = 10, offset: int = 0, entities: DataFrame | None = None) -> DataFrame:
    """A page, best first, path breaks ties; with ``entities`` only hits on those stay."""
    if entities is not None:
        hits = hits.join(entities.select("path").distinct(), "path", "left_semi")
    return hits.orderBy(F.col("score").desc(), "path").offset(offset).limit(limit)


def explained(hits: DataFrame, query: str, mode: str = "hybrid") -> DataFrame:
    """Hits with contributions, matched path terms and reasons."""
    terms = [t.lower() for t in query.split()]
    wv, wf = (VECTOR_WEIGHT, FTS_WEIGHT) if mode == "hybrid" else (1.0, 1.0)
    low = F.lower("path")
    matched = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms])) if terms else F.expr("cast(array() as array<string>)")
    v, f = F.col("vector_score"), F.col("fts_score")
    channel = F.when(F.col("source") == "hybrid", "matched in both vector and FTS channels").when(F.col("source") == "vector", "matched via semantic vector search").when(F.col("source") == "fts", "matched via full-text search (FTS)")
    reasons = F.array_compact(
        F.array(
            channel,
            F.when(F.size("matched_terms") > 0, F.concat(F.lit("path contains query term(s): "), F.array_join("matched_terms", ", "))),
            F.when(v.isNotNull(), F.concat(F.when(v >= 0.8, "high").when(v >= 0.6, "moderate").otherwise("low"), F.format_string(" semantic similarity (%.3f)", F.bround(v, 3)))),
            F.when(f.isNotNull(), F.concat(F.when(f >= 0.5, "strong").otherwise("weak"), F.format_string(" FTS match (score %.3f)", F.bround(f, 3)))),
        )
    )
    out = hits.withColumn("matched_terms", matched).withColumn("path_match", F.size("matched_terms") > 0)
    return out.withColumn("vector_contribution", v * wv).withColumn("fts_contribution", f * wf).withColumn("reasons", reasons)


def latest_per_path(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
