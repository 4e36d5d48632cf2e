"""Benchmark decontamination by size-partitioned MinHash containment, with DataFrame functions only.

A text becomes words (lower-cased; ``GAPS`` parts them) and then shingles of ``WORDS`` words.
An item is *contained* in a document if at least ``threshold`` of its distinct shingles occur there.

Items are partitioned by their number of shingles into size classes that double. A class has a
sketch size ``m``: twice the shingles that a contained item of the class may lack, and three. The
sketch of an item is its ``m`` smallest shingle hashes (bottom-m MinHash). A document that contains
the item lacks no more of the sketch than it may lack of the item, so candidates are the documents
that have the rest of it: the search has full recall by counting, not by chance.

Each class is probed on its own: its largest sketch hash is a ceiling for the hashes that matter to
it, and a bitmap of its sketches' hashes tells which of those can meet one. A document's array of
hashes is filtered by both, within the array and before any row is made of it; what passes is dealt
to the classes it passed for and joined with their probes.

Candidates are verified exactly: the item's shingles, as texts, that the document has are counted.

A side is broadcast only if its counted rows and bytes are within ``BROADCAST_ROWS`` and
``BROADCAST_BYTES``: sketch hashes, candidate ids, and the shingle texts by themselves. Beyond that
the joins shuffle on the shingle hash or the id.

Edge cases: null texts, and texts of fewer than five words, have no shingle and take no part; null
ids take part like others but rows without an id can't be told apart; repeated rows repeat in the
result; texts of any length are read whole; ties can't occur (every pair over the threshold is
returned); empty tables give an empty result; further input columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.session import cut

WORDS = 5
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000
BITS = 1 << 16  # of a class's bitmap, at most


#: What parts words: ASCII and Latin-1 characters that are no letter or digit, general and CJK punctuation.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF\xD7\xF7\u2000-\u206F\u3000-\u303F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words. Project it under a name before use: in a lambda it would run for each element."""
    return F.array_remove(F.split(F.lower(text), GAPS), "")


def hashes_of(words: Column, k: int = WORDS) -> Column:
    """64-bit hashes of all shingles of ``k`` words, in order, as an array."""
    n = F.size(words)

    def at(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(k)])

    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), at)).otherwise(F.expr("cast(array() as array<bigint>)"))


def shingles_of(words: Column, k: int = WORDS) -> Column:
    """The shingles as texts."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.expr("cast(array() as array<string>)"))


def bounded(df: DataFrame, rows: int, bytes_: int = 0) -> DataFrame:
    """Marked for broadcast if its counted rows and bytes allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES else df


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``(item, n, shingles, sketch)`` of every item with a shingle."""
    w = items.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") >= WORDS)
    s = w.select("item_id", F.array_distinct(shingles_of(F.col("w"))).alias("shingles"), F.array_sort(F.array_distinct(hashes_of(F.col("w")))).alias("h"))
    n = F.size("shingles")
    size_class = F.floor(F.log2(n)).cast("int")  # sizes from 2^class up to, but not including, 2^(class + 1)
    top = F.pow(F.lit(2.0), size_class + 1) - 1
    m = F.least(F.size("h"), (2 * F.floor(top * (1 - threshold) + 1e-9) + 3).cast("int"))
    lack = n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int")
    return s.select("item_id", n.alias("n"), size_class.alias("size_class"), "shingles", F.slice("h", F.lit(1), m).alias("sketch"), (m - lack).alias("least"))


def probes(probe: DataFrame) -> list[tuple[int, int, list[int]]]:
    """(size class, ceiling, bitmap) of every class; classes double, so there are a few dozen at most."""
    word = F.pmod(F.shiftright("h", 6), F.lit(BITS // 64)).cast("int")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = probe.groupBy("size_class", word.alias("word")).agg(F.bit_or(bit).alias("bits"), F.max("h").alias("top"))
    rows = words.groupBy("size_class").agg(F.max("top").alias("ceiling"), F.collect_list(F.struct("word", "bits")).alias("words")).collect()
    out = []
    for r in rows:
        bits = [0] * (BITS // 64)
        for w in r["words"]:
            bits[w["word"]] = w["bits"]
        out.append((r["size_class"], r["ceiling"], folded(bits)))
    return sorted(out)


def folded(bits: list[int]) -> list[int]:
    """A bitmap put together to as few words as leave most of its bits empty."""
    set_ = sum((b & ((1 << 64) - 1)).bit_count() for b in bits)
    while len(bits) > 1 and 16 * set_ <= 32 * len(bits):  # a sixteenth of half the size
        half = len(bits) // 2
        bits = [x | y for x, y in zip(bits[:half], bits[half:])]
    return bits


def passing(h: Column, bits: list[int], ceiling: int) -> Column:
    """The hashes of an array that a class's ceiling and bitmap (a constant of the plan) let through."""
    words = F.lit(np.array(bits, np.int64))
    met = lambda x: F.getbit(F.get(words, F.pmod(F.shiftright(x, 6), F.lit(len(bits))).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.filter(h, lambda x: (x <= F.lit(ceiling)) & met(x))


def search(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every contained item."""
    spark = docs.sparkSession
    known = cut(sketches(items, threshold))
    probe = cut(known.select("size_class", "item_id", "least", F.explode("sketch").alias("h")))
    out = ["doc_id", "item_id", "n_shingles", "n_shared", "containment"]
    classes = probes(probe)
    if not classes:
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id"))]
        return spark.createDataFrame([], "doc_id {}, item_id {}, n_shingles long, n_shared long, containment double".format(*kinds))
    ceiling, size = max(c for _, c, _ in classes), max(len(bits) for _, _, bits in classes)
    union = [reduce(or_, (bits[i % len(bits)] for _, _, bits in classes)) for i in range(size)]
    low = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    low = low.select("doc_id", passing(hashes_of(F.col("w")), union, ceiling).alias("h"))  # a filter here would split words for each hash
    tag = lambda h, k: F.transform(h, lambda x: F.struct(F.lit(k).alias("size_class"), x.alias("h")))
    tagged = [tag(passing(F.col("h"), bits, c), k) for k, c, bits in classes]
    low = low.select("doc_id", F.explode(F.concat(*tagged)).alias("x")).select("doc_id", "x.size_class", "x.h")
    met = low.join(bounded(probe, probe.count()), ["size_class", "h"]).groupBy("doc_id", "item_id", "least").agg(F.count_distinct("h").alias("met"))
    pairs = cut(met.where(F.col("met") >= F.col("least")).select("doc_id", "item_id"))
    ids = pairs.select("doc_id").distinct()
    near = docs.select("doc_id", "text").join(bounded(ids, ids.count()), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    have = near.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", F.array_distinct(shingles_of(F.col("w"))).alias("have"))
    both = have.alias("d").join(pairs.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))).select(F.col("d.doc_id").alias("doc_id"), "item_id", "have")
    held = known.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("shingles", " "))).alias("b")).first()
    shared = both.alias("b").join(bounded(known.select("item_id", "n", "shingles"), held["n"], held["b"]).alias("k"), F.col("b.item_id").eqNullSafe(F.col("k.item_id"))).select(
        "doc_id",
        F.col("k.item_id").alias("item_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("have", "shingles")).cast("long").alias("n_shared"),
    )
    return shared.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6)).where(F.col("n_shared") >= F.col("n_shingles") * F.lit(threshold) - 1e-9).select(*out)


def remove(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay."""
    found = cut(search(docs, items, threshold).select("doc_id").distinct())
    return docs.join(bounded(found, found.count()), docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")
