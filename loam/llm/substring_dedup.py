"""Substring dedup over word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. The minimiser of a window is the run of
``GRAM`` words in it with the smallest hash; consecutive windows that share their minimiser travel
as one packed string (their words, joined by one space: a *super-k-mer*) to the bucket of the
minimiser, so all equal windows meet in one bucket and each word travels about three times instead
of thirteen. A bucket sorts the windows of its distinct super-k-mers by a 64-bit hash and compares
the windows of each group byte by byte, so the grouping is exact; the smallest document of each
group decides. Spans that must go are sent back to the documents by id.

Hot passages: equal super-k-mers of one chunk (``CHUNK_BYTES`` of text) are settled before they are
sent: only the chunk's smallest document travels, so a passage in a third of all documents reaches
its bucket once for each chunk, not once for each document. The others are known to repeat it; their
spans go by a key of the chunk's own and never meet the rest. Buckets are sized from the corpus's
bytes (``BUCKET_BYTES``); a chunk sends one packed row to each bucket that it has something for, and
never more rows than super-k-mers.

Hot minimisers: three common words with a small hash would take all windows around them to one
bucket, though the windows differ. Those that a sample shows to be heavy are split by a second key,
the window's next smallest hash, so a frequent phrase in many contexts goes to many buckets.

Edge cases: null and empty texts have no words; a null id is in no match and its text is kept whole;
windows repeated within one document (or between rows with equal ids) don't remove anything; equal
ids are taken to have equal texts; of documents with one window only the smallest id keeps it, so
ties don't arise; texts of any length are used whole; empty tables give an empty
result; further input columns are ignored by ``digest``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import bytework as bw
from loam.session import cut, shuffle_width

WINDOW = 13
GRAM = 3
BUCKET_BYTES = 16_000_000
BROADCAST_IDS = 1_000_000
PACKED = "<i8 <i4 <i4 <i4 . <i8 <i4 <i4"
CHUNK_BYTES = 4_000_000
SAMPLE_BYTES = 64_000_000
HOT_BYTES = 1_000_000
HOT_MET = 32
_none = lambda *kinds: [b"" if k == "." else np.zeros(0, k) for k in kinds]
NO_STRINGS, NO_SPANS = _none(*PACKED.split()[:5]), _none(*PACKED.split()[5:])


def super_kmers(ids: np.ndarray, data: np.ndarray, starts: np.ndarray, window: int, gram: int, hot: np.ndarray = np.zeros(0, np.uint64)):
    """(document, first word, windows, key, packed string) of every super-k-mer of a chunk.

    The key is the minimiser, a hash. Under a ``hot`` one, windows also share the next smallest hash to
    travel together, and the key follows from both; either way equal windows have equal keys.
    """
    begin, end = bw.word_bounds(data)
    if len(begin) < window:
        return None
    doc = np.searchsorted(starts, begin, "right") - 1
    nth = np.arange(len(begin)) - np.searchsorted(begin, starts)[doc]
    word = bw.Slices(data)(begin, end)
    order = bw.Slices(word)(np.arange(len(word) - gram + 1), np.arange(gram, len(word) + 1))
    width = window - gram + 1
    at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    if not len(at):
        return None
    least = np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1)[at] + at
    second = np.zeros(len(at), np.uint64)
    many = np.flatnonzero(np.isin(order[least], hot)) if len(hot) else ()
    for i in range(0, len(many), 65_536):
        part = many[i : i + 65_536]
        second[part] = np.partition(np.lib.stride_tricks.sliding_window_view(order, width)[at[part]], 1, axis=1)[:, 1] if width > 1 else 0
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(least) != 0) | (second[1:] != second[:-1])]
    first, second = at[new], second[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(at)])
    last_word = first + count - 1 + window - 1
    keep = ~bw.SPACE[data]
    keep[end] = True
    plain = np.where(bw.SPACE[data], 0x20, data)[keep].astype(np.uint8).tobytes()  # words joined by one space
    size = end - begin
    place = np.cumsum(size + 1) - size - 1
    strings = [plain[a:b] for a, b in zip(place[first].tolist(), (place[last_word] + size[last_word]).tolist())]
    key = order[least[new]]
    return ids[doc[first]], nth[first], count, np.where(second > 0, bw.mix(key) ^ second, key), strings


def settle(doc: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which super-k-mers repeat an equal one of a smaller document in the same chunk."""
    seen: dict[bytes, int] = {}
    uid = np.array([seen.setdefault(s, len(seen)) for s in strings], np.int64)
    if len(seen) == len(strings):
        return np.zeros(len(strings), bool)
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, uid, doc)
    return doc > least[uid]


def hot_minimisers(text: DataFrame, total: int, window: int, gram: int) -> np.ndarray:
    """Minimisers that would bring more than ``HOT_BYTES`` to their bucket, estimated on a sample.

    The sample has about ``SAMPLE_BYTES`` of documents, by a hash of their ids; it only decides how
    windows are dealt, and the result is the same for any. A hot one was met ``HOT_MET`` times in the
    sample, so there are few.
    """
    rate = min(1.0, SAMPLE_BYTES / max(1, total))
    drawn = text.where(F.xxhash64("doc_id", F.lit(11)) < F.lit(int(rate * 2**63) * 2 - 2**63)) if rate < 1 else text

    def run(batches):
        for ids, data, starts in bw.chunks(batches, CHUNK_BYTES):
            got = super_kmers(ids, data, starts, window, gram)
            if got is None:
                continue
            doc, _, _, key, strings = got
            sent = np.flatnonzero(~settle(doc, strings))
            token, at = np.unique(key[sent], return_inverse=True)
            size = np.bincount(at, [len(strings[i]) for i in sent.tolist()]).astype(np.int64)
            met = np.bincount(at)
            own = met > 1
            yield pa.record_batch([pa.array(token[own].view(np.int64)), pa.array(met[own]), pa.array(size[own])], names=["token", "met", "size"])

    loads = drawn.mapInArrow(run, "token long, met long, size long").groupBy("token").agg(F.sum("met").alias("met"), F.sum("size").alias("size"))
    rows = loads.where((F.col("met") >= HOT_MET) & (F.col("size") >= HOT_BYTES * rate)).select("token").collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def map_chunks(buckets: int, window: int, gram: int, hot: np.ndarray = np.zeros(0, np.uint64)):
    def run(batches):
        for ids, data, starts in bw.chunks(batches, CHUNK_BYTES):
            got = super_kmers(ids, data, starts, window, gram, hot)
            if got is None:
                continue
            doc, first, count, minimiser, strings = got
            settled = settle(doc, strings)
            bucket = (bw.mix(minimiser + np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
            order = np.flatnonzero(~settled)
            order = order[np.argsort(bucket[order], kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows_b, rows_p = [], []
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                sent = order[lo:hi]
                texts = [strings[i] for i in sent.tolist()]
                rows_b.append(int(bucket[sent[0]]))
                rows_p.append(bw.pack(np.diff(doc[sent], prepend=0).astype("<i8"), np.diff(first[sent], prepend=0).astype("<i4"), count[sent].astype("<i4"), np.array([len(t) for t in texts], "<i4"), b"".join(texts), *NO_SPANS))
            gone = np.flatnonzero(settled)
            if len(gone):  # decided: by a key of the chunk's own, away from the minimisers' buckets
                rows_b.append(buckets + int(bw.mix(ids[:1].astype(np.int64).view(np.uint64))[0] % np.uint64(buckets)))
                rows_p.append(bw.pack(*NO_STRINGS, np.diff(doc[gone], prepend=0).astype("<i8"), first[gone].astype("<i4"), count[gone].astype("<i4")))
            yield pa.record_batch([pa.array(rows_b, pa.int32()), pa.array(rows_p, pa.binary())], names=["bucket", "payload"])

    return run


def window_groups(texts: list[bytes], least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of distinct strings: the smallest document of all equal windows; and each string's first window."""
    begins, ends, owner, hashes = [], [], [], []
    i = 0
    while i < len(texts):  # hashing needs 24 bytes a byte, so it goes by pieces
        j, n = i, 0
        while j < len(texts) and (n < 1_000_000 or j == i):
            n += len(texts[j]) + 1
            j += 1
        data = np.frombuffer(b" ".join(texts[i:j]) + b" ", np.uint8)
        begin, end = bw.word_bounds(data)
        lens = np.array([len(t) + 1 for t in texts[i:j]])
        edge = np.r_[0, np.cumsum(lens)]
        own = np.searchsorted(edge, begin, "right") - 1
        ok = np.flatnonzero(own[: len(own) - window + 1] == own[window - 1 :])
        hashes.append(bw.Slices(data)(begin[ok], end[ok + window - 1]))
        begins.append(begin[ok] - edge[own[ok]])
        ends.append(end[ok + window - 1] - edge[own[ok]])
        owner.append(own[ok] + i)
        i = j
    h, own, a, b = map(np.concatenate, (hashes, owner, begins, ends))
    order = np.argsort(h, kind="stable")
    cuts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    size = np.diff(np.r_[cuts, len(order)])
    best = np.minimum.reduceat(least[own[order]], cuts)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(best, size)
    for c, n in zip(cuts[size > 1].tolist(), size[size > 1].tolist()):
        members = order[c : c + n].tolist()
        t = [texts[own[m]][a[m] : b[m]] for m in members]
        if any(x != t[0] for x in t):  # a hash collision: group by the bytes themselves
            by: dict[bytes, int] = {}
            for m, x in zip(members, t):
                by[x] = min(by.get(x, np.iinfo(np.int64).max), int(least[own[m]]))
            for m, x in zip(members, t):
                out[m] = by[x]
    return out, np.searchsorted(own, np.arange(len(texts) + 1))


def reduce_bucket(window: int):
    def run(table: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        cols: list[list[np.ndarray]] = [[], [], [], []]
        gone: list[list[np.ndarray]] = [[], [], []]
        for p in table.column("payload"):
            doc, first, count, size, text, *settled = bw.unpack(p.as_py(), PACKED)
            doc, first, settled[0] = np.cumsum(doc, dtype=np.int64), np.cumsum(first, dtype=np.int64), np.cumsum(settled[0], dtype=np.int64)
            edge = np.r_[0, np.cumsum(size, dtype=np.int64)].tolist()
            uid = np.array([seen.setdefault(text[x:y], len(seen)) for x, y in zip(edge, edge[1:])], np.int64)
            for c, v in zip(cols, (doc, first, count, uid)):
                c.append(v)
            for c, v in zip(gone, settled):
                c.append(v)
        doc, first, count, uid = map(np.concatenate, cols)
        out_doc, out_a, out_n = map(np.concatenate, gone)
        if len(doc):
            least = np.full(len(seen), np.iinfo(np.int64).max)
            np.minimum.at(least, uid, doc)
            best, at = window_groups(list(seen), least, window)
            entry, j = bw.ragged(count.astype(np.int64))
            hit = best[at[uid[entry]] + j] < doc[entry]
            entry, j = entry[hit], j[hit]
            if len(entry):
                new = np.r_[True, (np.diff(entry) != 0) | (np.diff(j) != 1)]
                run = np.diff(np.r_[np.flatnonzero(new), len(entry)])
                e, j = entry[new], j[new]
                out_doc = np.r_[out_doc, doc[e]]
                out_a, out_n = np.r_[out_a, first[e] + j], np.r_[out_n, run]
        lo = out_a.astype(np.int64)
        return pa.table({"doc_id": pa.array(out_doc, pa.int64()), "span": pa.array((lo << 32) | (lo + out_n + window - 1), pa.int64())})

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, spans``: word ranges (``first << 32 | end``) that windows of smaller documents cover."""
    text = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(docs.sparkSession), -(-3 * total // BUCKET_BYTES), 1)
    hot = hot_minimisers(text, total, window, gram)
    sent = text.mapInArrow(map_chunks(buckets, window, gram, hot), "bucket int, payload binary")
    spans = sent.groupBy("bucket").applyInArrow(reduce_bucket(window), "doc_id long, span long")
    return spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def merged(spans: list[int], end: int) -> list[tuple[int, int]]:
    """Ranges put together, in order."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans):
        a, b = s >> 32, min(s & 0xFFFFFFFF, end)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _digest(batches):
    for batch in batches:
        n, removed, kept = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n.append(len(words))
            gone = merged(spans.as_py(), len(words)) if spans.is_valid else []
            left, at = [], 0
            for a, b in gone:
                left += words[at:a]
                at = b
            left += words[at:]
            removed.append(n[-1] - len(left))
            kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row."""
    spans = cut(repeated_spans(docs, window))
    rows = docs.select("doc_id", "text")
    if spans.count() <= BROADCAST_IDS:  # only texts with spans travel
        ids = F.broadcast(spans.select("doc_id"))
        whole = rows.join(ids, "doc_id", "left_anti").withColumn("spans", F.lit(None).cast("array<bigint>"))
        both = rows.join(ids, "doc_id", "left_semi").join(spans, "doc_id").select("doc_id", "text", "spans").union(whole)
    else:
        both = rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
