"""Near duplicates by SimHash and the generalised pigeonhole principle.

A text's fingerprint has 64 bits: bit ``i`` is set if it is set in over half of the 64-bit hashes of
the text's word shingles. Fingerprints link if at most ``RADIUS`` bits differ.

1. Each text gives its fingerprint in one pass; only distinct fingerprints go on.
2. The bits' correlations are counted over all fingerprints, and bits that go together share a
   partition. More fingerprints get fewer and wider partitions (``partition_count``).
3. With ``m`` partitions, thresholds ``t_i >= -1`` of the sum ``RADIUS - m + 1`` lose no link: of two
   fingerprints within ``RADIUS``, some partition's parts differ in at most ``t_i`` bits. A
   fingerprint gets its own thresholds, by dynamic programming over the partitions on the number of
   candidates that each threshold is estimated to give: the counts of the partition's frequent
   values (``HEAVY`` at most) within the threshold, and for all other values their mean.
4. Every fingerprint is stored under each part's value, and probes the values within its thresholds.
   Values are dealt to buckets of about ``BUCKET_ROWS`` entries; candidates are verified on all bits
   there, and a bucket gives a spanning forest of its links and not the links.
5. A value with ``HOT`` members or more (near copies of one template, which agree in all parts) is
   settled apart. Its fingerprints meet first in the values at distance 1 of themselves, which at
   most 65 fingerprints can share: that finds all links of up to two bits, in linear work. Then only
   pairs of different components are left, so each value compares its members outside its largest
   component with all, in cells of ``CELL`` x ``CELL`` over many tasks.
6. Connected components of the forests, by contraction in DataFrame joins.

Edge cases: a null or empty text or one without words has fingerprint zero, which links like any
other; equal texts have equal fingerprints; a text of any length is read whole, in blocks of
hashes; a null doc_id is a row like others, and a component's id is its smallest id that isn't null;
repeated rows stay; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import bytework as bw
from loam.llm.components import components
from loam.session import cut

BITS = 64
WORDS = 3
SEED = 42
RADIUS = 3
HEAVY = 1024
HOT = 4096
CELL = 8192
BUCKET_ROWS = 250_000
BROADCAST_ROWS = 200_000
_HASHES = 1 << 16
_PAIRS = 1 << 21
_GAP = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    data = _GAP.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip(b" ")  # bytes: A-Z alone
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
    start, end = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    k = min(words, len(start))
    start, end = start[: len(start) - k + 1], end[k - 1 :]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(start), _HASHES):
        pairs = zip(start[at : at + _HASHES].tolist(), end[at : at + _HASHES].tolist())
        ones += bit_matrix(np.array([digest(data[a:b], SEED) for a, b in pairs], np.uint64)).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view(np.int64)[0])


def bit_matrix(values: np.ndarray) -> np.ndarray:
    """Row ``r`` has the bits of ``values[r]``, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, f``: the fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(f)], names=["doc_id", "f"])
        bw.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, f long")


def partition_count(n: int, radius: int = RADIUS) -> int:
    """The number of partitions with the least probes and candidates a fingerprint, for ``n`` even ones."""

    def cost(m: int) -> float:
        units, width = radius + 1, BITS / m
        shares = [units // m + (i < units % m) for i in range(m)]
        return sum(variants(round(width), u - 1) * (1 + n / 2.0**width) for u in shares)

    return min(range(2, radius + 3), key=cost)


def variants(width: int, t: int) -> int:
    """How many values of ``width`` bits differ from one in at most ``t``."""
    out, term = 0, 1
    for k in range(t + 1):
        out, term = out + term, term * (width - k) // (k + 1)
    return out


@cache
def masks(width: int, t: int) -> np.ndarray:
    """What to flip for all variants within ``t`` bits."""
    return np.array([sum(1 << b for b in at) for k in range(t + 1) for at in combinations(range(width), k)], np.int64)


def group_bits(n: int, ones: np.ndarray, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of near equal width; each grows by the bit that goes best with it.

    ``ones`` counts each bit over ``n`` fingerprints, ``both`` each pair of bits.
    """
    p = ones / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    left, parts = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        part = [max(left, key=lambda b: (max(phi[b, x] for x in left), -b))]
        left.remove(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (phi[b, part].sum(), -b))
            left.remove(best)
            part.append(best)
        parts.append(sorted(part))
    return parts


def parts_of(f: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """Row ``i`` has partition ``i``'s value of every fingerprint."""
    out = np.zeros((len(parts), len(f)), np.int64)
    for i, bits in enumerate(parts):
        for k, b in enumerate(bits):
            out[i] |= ((f >> np.int64(b)) & np.int64(1)) << np.int64(k)
    return out


def allocate(values: np.ndarray, widths: list[int], mean: list[float], heavy: list[tuple[np.ndarray, np.ndarray]], radius: int = RADIUS) -> np.ndarray:
    """Thresholds (partitions x fingerprints) of the least estimated cost, by dynamic programming.

    A threshold of ``t`` in a partition takes ``t + 1`` of the ``radius + 1`` units that there are.
    """
    m, n, units = len(widths), values.shape[1], radius + 1
    cost = np.zeros((m, units + 1, n))
    for i, width in enumerate(widths):
        value, count = heavy[i]
        near = np.zeros((units, n))
        for at in range(0, n, max(1, _PAIRS // max(1, len(value)))):
            cut_ = slice(at, at + max(1, _PAIRS // max(1, len(value))))
            apart = np.bitwise_count(values[i, cut_, None] ^ value[None, :])
            for t in range(units):
                near[t, cut_] = (apart <= t) @ count
        for u in range(1, units + 1):
            cost[i, u] = variants(width, u - 1) * (1 + mean[i]) + near[u - 1]
    best, took = np.full((units + 1, n), np.inf), np.zeros((m, units + 1, n), np.int8)
    best[0] = 0
    for i in range(m):
        new = np.full((units + 1, n), np.inf)
        for s in range(units + 1):
            for u in range(s + 1):
                c = best[s - u] + cost[i, u]
                better = c < new[s]
                new[s][better], took[i, s][better] = c[better], u
        best = new
    out, s = np.zeros((m, n), np.int8), np.full(n, units)
    for i in reversed(range(m)):
        out[i] = took[i, s, np.arange(n)]
        s = s - out[i]
    return out - 1


def _counted_bits(uniques: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(fingerprints, count of each bit, count of each pair of bits), over all of them."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(f), _HASHES):
                x = bit_matrix(f[at : at + _HASHES]).astype(np.float32)  # products are counts below 2**24: exact
                total += (x.T @ x).astype(np.int64)
            n += len(f)
        yield pa.record_batch([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.r_[total.ravel(), n])], names=["k", "n"])

    rows = uniques.select("f").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 4,097 rows
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r["k"]] = r["n"]
    both = flat[:-1].reshape(BITS, BITS)
    return int(flat[-1]), both.diagonal().copy(), both


def _stored(uniques: DataFrame, parts: list[list[int]]) -> DataFrame:
    """``part, value, f`` of every fingerprint and partition."""

    def run(batches):
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            v = parts_of(f, parts)
            part = np.repeat(np.arange(len(parts), dtype=np.int32), len(f))
            yield pa.record_batch([pa.array(part), pa.array(v.ravel()), pa.array(np.tile(f, len(parts)))], names=["part", "value", "f"])

    return uniques.select("f").mapInArrow(run, "part int, value long, f long")


def _probes(uniques: DataFrame, parts: list[list[int]], mean: list[float], heavy: list, radius: int) -> DataFrame:
    """``part, value, f``: the values that each fingerprint probes."""
    widths = [len(p) for p in parts]

    def run(batches):
        for b in batches:
            all_f = b.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(all_f), 8192):
                f = all_f[start : start + 8192]
                v = parts_of(f, parts)
                t = allocate(v, widths, mean, heavy, radius)
                for i, width in enumerate(widths):
                    for k in range(radius + 1):
                        at, flips = np.flatnonzero(t[i] == k), masks(width, k)
                        step = max(1, _PAIRS // len(flips))
                        for s in range(0, len(at), step):
                            x = at[s : s + step]
                            value = (v[i, x, None] ^ flips[None, :]).ravel()
                            yield pa.record_batch([pa.array(np.full(len(value), i, np.int32)), pa.array(value), pa.array(np.repeat(f[x], len(flips)))], names=["part", "value", "f"])

    return uniques.select("f").mapInArrow(run, "part int, value long, f long")


class Forest:
    """Components of numbered nodes while links come in."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _verified(f: np.ndarray, store: np.ndarray, store_key: np.ndarray, probe: np.ndarray, probe_key: np.ndarray, radius: int) -> np.ndarray:
    """Roots of the nodes ``f`` by the links between probes and stored entries of equal key.

    ``store`` and ``probe`` are numbers of nodes. Candidates are made and tested a block at a time.
    """
    forest = Forest(len(f))
    order = np.argsort(store_key, kind="stable")
    store, store_key = store[order], store_key[order]
    low, high = np.searchsorted(store_key, probe_key), np.searchsorted(store_key, probe_key, "right")
    upto, at = np.cumsum(high - low), 0
    while at < len(probe):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + _PAIRS, "right")))
        which, nth = bw.ragged(high[at:to] - low[at:to])
        a, b = probe[at:to][which], store[low[at:to][which] + nth]
        near = (a != b) & (apart_in(f[a], f[b]) <= radius)
        forest.link(a[near], b[near])
        at = to
    return forest.root


def apart_in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the values differ; unsigned, as a signed number's bits are those of its magnitude."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _links(f: np.ndarray, root: np.ndarray) -> pa.Table:
    own = np.flatnonzero(root != np.arange(len(f)))
    return pa.table({"a": pa.array(f[own]), "b": pa.array(f[root[own]])})


def _bucket_links(radius: int):
    def run(table: pa.Table) -> pa.Table:
        f, node = np.unique(table.column("f").to_numpy(), return_inverse=True)
        # one key for partition and value: values have at most 32 bits
        key = (table.column("part").to_numpy().astype(np.int64) << np.int64(33)) | table.column("value").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        return _links(f, _verified(f, node[~asks], key[~asks], node[asks], key[asks], radius))

    return bw.trimmed(run)


def _cell_links(radius: int):
    def run(table: pa.Table) -> pa.Table:
        f, node = np.unique(table.column("f").to_numpy(), return_inverse=True)
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        group = np.zeros(len(f), np.int64)
        group[node] = table.column("group").to_numpy()
        forest, members = Forest(len(f)), node[~asks]
        for p in np.array_split(node[asks], max(1, int(asks.sum()) * len(members) // _PAIRS)):
            a, b = np.repeat(p, len(members)), np.tile(members, len(p))
            near = (group[a] != group[b]) & (apart_in(f[a], f[b]) <= radius)
            forest.link(a[near], b[near])
        return _links(f, forest.root)

    return bw.trimmed(run)


def ball_links(fs: DataFrame) -> DataFrame:
    """``a, b``: links whose components are those of all links of up to two differing bits.

    Fingerprints differ in two bits or fewer if and only if some value is within one bit of both. A
    value has 65 such fingerprints at most, whatever the input.
    """

    def run(batches):
        flips = masks(BITS - 1, 1)
        flips = np.r_[flips, np.int64(-(1 << 63))]
        for b in batches:
            all_f = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_f), 8192):
                f = all_f[at : at + 8192]
                yield pa.record_batch([pa.array((f[:, None] ^ flips[None, :]).ravel()), pa.array(np.repeat(f, len(flips)))], names=["z", "f"])

    met = fs.select("f").mapInArrow(run, "z long, f long").groupBy("z").agg(F.min("f").alias("a"), F.collect_set("f").alias("all"))
    return met.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _hot_links(store: DataFrame, probes: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Links of the hot values' entries: those of two bits or fewer, and the others between components."""
    nodes = store.select("f").union(probes.select("f")).distinct()
    near = cut(ball_links(nodes))
    group = components(near).select(F.col("id").alias("f"), F.col("root").alias("g"))
    grouped = lambda df: cut(df.join(group, "f", "left").withColumn("group", F.coalesce("g", "f")).drop("g"))
    store, probes = grouped(store), grouped(probes)
    value = ["part", "value"]
    sizes = store.groupBy(*value, "group").count()
    largest = sizes.groupBy(*value).agg(F.max_by("group", F.struct("count", "group")).alias("main"), F.sum("count").alias("n"))
    store, probes = store.join(largest, value), probes.join(largest, value)
    out = []
    # a probe outside the main component meets all members, one inside it the members outside
    for asks, held in ((probes.where("group <> main"), store), (probes.where("group = main"), store.where("group <> main"))):
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL).cast("int"))
        cell = lambda df: df.withColumn("cell", F.pmod(F.xxhash64("f"), blocks).cast("int"))
        every = F.explode(F.sequence(F.lit(0), blocks - 1))
        met = asks.groupBy(*value).agg(F.first("n").alias("n")).select(*value)  # values that nothing asks for are left out
        members = cell(held.join(met, value, "left_semi")).withColumn("asker", every).select(*value, "cell", "asker", "f", "group", F.lit(False).alias("asks"))
        askers = cell(asks).withColumnRenamed("cell", "asker").withColumn("cell", every).select(*value, "cell", "asker", "f", "group", F.lit(True).alias("asks"))
        out.append(members.unionByName(askers).groupBy(*value, "cell", "asker").applyInArrow(_cell_links(radius), "a long, b long"))
    return near, out[0].unionByName(out[1])


def links(uniques: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame | None:
    """``a, b``: links with the components of all links between the distinct fingerprints ``f``; None without any."""
    n, ones, both = _counted_bits(uniques)
    if n < 2:
        return None
    parts = group_bits(n, ones, both, partition_count(n, radius))
    widths = [len(p) for p in parts]
    stored = _stored(uniques, parts)
    frequent = cut(stored.groupBy("part", "value").count().where(F.col("count") >= min(hot, max(2, n // HEAVY))))
    top = frequent.where(F.col("count") >= max(2, n // HEAVY)).orderBy(F.col("count").desc(), "part", "value").limit(HEAVY * len(parts)).collect()
    heavy = [(np.array([r["value"] for r in top if r["part"] == i], np.int64), np.array([r["count"] for r in top if r["part"] == i], np.float64)) for i in range(len(parts))]
    mean = [max(0.0, n - c.sum()) / 2.0 ** widths[i] for i, (_, c) in enumerate(heavy)]
    probes = _probes(uniques, parts, mean, heavy, radius)
    hot_values = frequent.where(F.col("count") >= hot).select("part", "value", F.lit(True).alias("hot"))
    n_hot, extra = hot_values.count(), None
    if n_hot:
        known = F.broadcast(hot_values) if n_hot <= BROADCAST_ROWS else hot_values
        marked = lambda df: df.join(known, ["part", "value"], "left")
        hot_store, hot_probes = marked(stored).where("hot").drop("hot"), marked(probes).where("hot").drop("hot")
        extra = _hot_links(hot_store, hot_probes, radius)
        stored, probes = marked(stored).where("hot is null").drop("hot"), marked(probes).where("hot is null").drop("hot")
    units, m = radius + 1, len(parts)
    each = m + sum(variants(w, units // m + (i < units % m) - 1) for i, w in enumerate(widths))
    buckets = max(1, -(-n * each // BUCKET_ROWS))
    entries = stored.withColumn("asks", F.lit(False)).unionByName(probes.withColumn("asks", F.lit(True)))
    dealt = entries.withColumn("bucket", F.pmod(F.xxhash64("part", "value"), F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInArrow(_bucket_links(radius), "a long, b long")
    for more in extra or ():
        found = found.unionByName(more)
    return found


def classes(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = cut(fingerprints(docs, words))
    uniques = cut(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    found = links(uniques, radius, hot)
    if found is None:
        owner = uniques.select("f", F.col("least").alias("component_id"))
    else:
        roots = components(cut(found)).withColumnRenamed("id", "f")
        member = uniques.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
        least = member.groupBy("root").agg(F.min("least").alias("component_id"))
        owner = member.join(least, "root").select("f", "component_id")
    hexed = F.lower(F.lpad(F.hex("f"), 16, "0"))
    # one fingerprint may hold many rows; its row on the other side is single, so a skewed join splits it
    return prints.join(owner, "f").select("doc_id", hexed.alias("fingerprint"), F.col("component_id").cast(kind).alias("component_id"))


def dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with the smallest id; rows without an id stay."""
    keep = classes(docs.where("doc_id is not null"), words, radius).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
