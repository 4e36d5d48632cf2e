"""Numpy helpers for work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes 0x20 and 0x09 to 0x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
KEPT_POWERS = 1 << 16


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", _INVERSE)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up, cls.down

    @classmethod
    def shrink(cls) -> None:
        cls.up, cls.down = cls.up[:KEPT_POWERS].copy(), cls.down[:KEPT_POWERS].copy()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Slices:
    """64-bit hashes of arbitrary slices of one array, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        up, self.down = _Powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        terms = values.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[: len(values)]
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def give_back() -> None:
    """Return freed memory to the system: idle workers stay, and what they hold counts against the executor."""
    _Powers.shrink()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def trimmed(f):
    """``f`` of a table, which gives its memory back afterwards."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    return run


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def chunks(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, starts) for runs of documents of about ``limit`` bytes.

    ``batches`` have an id and a text, neither of them null. A space follows each document in
    ``bytes``; document ``i`` is ``bytes[starts[i] : starts[i + 1] - 1]``. A longer document stands alone.
    """
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        text = batch.column(1).cast(pa.large_binary())
        _, offsets, data = text.buffers()
        n = len(text)
        off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            j = min(j, n)
            starts = (off[i : j + 1] - off[i]) + np.arange(j - i + 1)
            out = np.full(int(starts[-1]), 0x20, np.uint8)
            for k in range(i, j):
                a = int(starts[k - i])
                out[a : a + int(off[k + 1] - off[k])] = raw[off[k] : off[k + 1]]
            yield ids[i:j], out, starts
            i = j
    give_back()


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, whose last byte is a space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.r_[0, edge]
    return edge[0::2], edge[1::2]


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes, the group and the place in it of every member."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array by significance: the upper ones of small numbers compress to nothing."""
    return np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).T).tobytes()


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed byte string."""
    parts = [a if isinstance(a, bytes) else _planes(np.ascontiguousarray(a)) for a in arrays]
    raw = struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpack(data: bytes, kinds: str) -> list:
    """What ``pack`` packed; ``kinds`` has a numpy type letter for each array and ``.`` for bytes."""
    names = kinds.split()
    raw = pa.decompress(data[8:], decompressed_size=struct.unpack_from("<q", data)[0], codec="zstd", asbytes=True)
    sizes = struct.unpack_from(f"<{len(names)}q", raw)
    out, at = [], 8 * len(names)
    for kind, size in zip(names, sizes):
        if kind == ".":
            out.append(raw[at : at + size])
        else:
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(raw, np.uint8, size, at).reshape(width, size // width)
            out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out
