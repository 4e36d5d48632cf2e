"""URL filters: exact membership of URL keys in a rule list through a cascade of Bloom filters.

The rule list is a set of keys ``host + path``. A URL has one candidate key for every suffix of
its host and every rule-path length in use; its rule is the longest candidate that is listed.
Membership is decided by a *cascade*: level 1 encodes the listed keys; level 2 the keys of the
corpus that level 1 takes wrongly; level 3 the listed keys that level 2 takes wrongly; and so on
until a level has no false positive. The corpus's complete key universe has gone through the
build, so the parity of the first level that lacks a key is its exact membership: no join is made,
neither at the build nor at the lookup, and only the build holds the rule list.

Sizes: a level has ``BITS_PER_KEY`` bits for each key it encodes. Rules are a driver-side list by
contract (``MAX_RULES``); false positives of a level are counted before they are encoded, and they
are about 1% of the keys that the level before it was tested with. A level of more than
``MAX_LEVEL_BITS`` raises an error instead of being broadcast.

Past the bounds nothing is dropped: the build fails. At 10 bits a key, ``MAX_LEVEL_BITS`` holds 214
million keys (256 MB to each worker); a list near it should be split by host beforehand.

Edge cases: of listed keys of equal length the one with the longer host wins; urls of any length are
read whole; a null url or one without ``://`` has empty host and path, no rule and the default
verdict; an empty table gives an empty result; repeated rows are judged one by one; further
columns of the input are ignored by ``judge``; a listed key whose host is empty never fits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
HASHES = 7
MAX_RULES = 5_000_000
MAX_LEVEL_BITS = 1 << 31
MAX_LEVELS = 64


URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: str):
    """Columns ``host`` (A-Z lower-cased) and ``path`` of a url column; both empty without ``://``."""
    host = F.translate(F.regexp_extract(url, URL_PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``verdict`` for every URL on ``host`` or below whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass
class Level:
    """One Bloom filter."""

    bits: int
    words: np.ndarray
    seed: int

    @classmethod
    def empty(cls, keys: int, seed: int) -> Level:
        bits = max(64, 1 << (max(1, keys) * BITS_PER_KEY - 1).bit_length())
        if bits > MAX_LEVEL_BITS:
            raise ValueError(f"a level of {bits} bits is over the broadcast bound of {MAX_LEVEL_BITS}")
        return cls(bits, np.zeros(bits // 8, np.uint8), seed)

    def slots(self, key: str) -> list[int]:
        h1, h2 = struct.unpack("<QQ", hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16, salt=struct.pack("<Q", self.seed)).digest())
        return [(h1 + i * (h2 | 1)) % self.bits for i in range(HASHES)]

    def add(self, key: str) -> None:
        for s in self.slots(key):
            self.words[s >> 3] |= 1 << (s & 7)

    def __contains__(self, key: str) -> bool:
        return all(self.words[s >> 3] >> (s & 7) & 1 for s in self.slots(key))


class Cascade:
    """Alternating Bloom filters; exact over the keys that it was built with."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        depth = 0
        for level in self.levels:
            if key not in level:
                break
            depth += 1
        return depth % 2 == 1


def candidate_keys(host: str, path: str, depths: Iterable[int]) -> list[tuple[str, str]]:
    """(host suffix, path prefix) of every rule that could fit, for the path lengths that rules have."""
    if not host:
        return []
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    return [(s, path[:d]) for s in suffixes if s for d in depths if len(path) >= d]


def build_cascade(keys: DataFrame, listed: set[str], depths: list[int]) -> Cascade:
    """Build over ``keys(host, path)``, the complete universe: candidate keys of all its rows.

    Every level is one scan that sends back each task's distinct false positives as an OR-able
    bitmap; the bitmaps are merged slice by slice on the executors before they reach the driver.
    """
    spark = keys.sparkSession
    levels = [Level.empty(len(listed), 1)]
    for k in listed:
        levels[0].add(k)
    held = spark.sparkContext.broadcast(listed)
    inside = listed  # the listed keys that all levels so far take
    while True:
        if len(levels) == MAX_LEVELS:  # a level keeps about a hundredth, so this is no size of input but a broken hash
            raise ValueError(f"{MAX_LEVELS} levels leave false positives")
        seed = len(levels) + 1
        shared = spark.sparkContext.broadcast(levels)
        if len(levels) % 2:  # now encode the universe's false positives
            passed = keys.mapInArrow(_passing(shared, held, depths), "h long")
            n = passed.agg(F.approx_count_distinct("h", 0.02).alias("n")).first()["n"]
            if not n:
                break
            level = Level.empty(int(n * 1.1) + 1, seed)
            bits, words = level.bits, level.words
            parts = keys.mapInArrow(_bitmaps(shared, held, depths, bits, seed), "part int, bitmap binary")
            merged = parts.groupBy("part").applyInArrow(_merge, "part int, bitmap binary")
            for r in merged.toLocalIterator():
                lo = r["part"] * SLICE
                words[lo : lo + len(r["bitmap"])] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        else:  # listed keys that the last level takes wrongly
            inside = {k for k in inside if k in levels[-1]}
            if not inside:
                break
            level = Level.empty(len(inside), seed)
            for k in inside:
                level.add(k)
        levels.append(level)
    return Cascade(levels)


SLICE = 1 << 20


def _wrong(batches: Iterator[pa.RecordBatch], levels: list[Level], listed: set[str], depths: list[int]) -> Iterator[str]:
    """Distinct keys of one task that are not listed and that all levels take."""
    seen: set[str] = set()
    for batch in batches:
        hosts, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for host, path in zip(hosts, paths):
            for a, b in candidate_keys(host, path, depths):
                key = a + b
                if key in seen:
                    continue
                if len(seen) > 200_000:  # only saves repeated work; forgetting is harmless
                    seen.clear()
                seen.add(key)
                if all(key in level for level in levels) and key not in listed:
                    yield key


def _passing(levels, listed, depths):
    def run(batches):
        found = [int.from_bytes(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for k in _wrong(batches, levels.value, listed.value, depths)]
        if found:
            yield pa.record_batch([pa.array(found, pa.int64())], names=["h"])

    return run


def _bitmaps(levels, listed, depths, bits, seed):
    def run(batches):
        level, touched = Level(bits, np.zeros(bits // 8, np.uint8), seed), False
        for key in _wrong(batches, levels.value, listed.value, depths):
            level.add(key)
            touched = True
        if touched:
            parts = [(i, level.words[i * SLICE : (i + 1) * SLICE].tobytes()) for i in range(-(-len(level.words) // SLICE))]
            yield pa.record_batch([pa.array([p for p, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["part", "bitmap"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    rows = table.column("bitmap").to_pylist()
    out = np.zeros(len(rows[0]), np.uint8)
    for r in rows:
        out |= np.frombuffer(r, np.uint8)
    return pa.table({"part": table.column("part")[:1], "bitmap": pa.array([out.tobytes()], pa.binary())})


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rule`` is the longest listed key that fits, null if none does; the verdict is the rule's,
    else ``default``: a key that no level lists is in no list. Two cascades are built: of all
    listed keys, and of those that block.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = url_parts(url_col)
    base = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keys = base.select("host", "path")
    depths = sorted({len(r.path) for r in rules})
    listed = build_cascade(keys, {r.key for r in rules}, depths)
    blocking = build_cascade(keys, {r.key for r in rules if r.verdict == "block"}, depths)
    shared = pages.sparkSession.sparkContext.broadcast((listed, blocking))
    schema = f"{id_col} {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches):
        listed, blocking = shared.value
        memo: dict[str, bool] = {}
        for batch in batches:
            rules_out, verdicts = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                best = ""
                for a, b in candidate_keys(host, path, depths):
                    key = a + b
                    if len(key) > len(best):
                        got = memo.get(key)
                        if got is None:
                            if len(memo) > 200_000:
                                memo.clear()
                            got = memo[key] = key in listed
                        if got:
                            best = key
                rules_out.append(best or None)
                verdicts.append(("block" if best in blocking else "allow") if best else default)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(rules_out, pa.string()), pa.array(verdicts, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    return base.mapInArrow(run, schema)
