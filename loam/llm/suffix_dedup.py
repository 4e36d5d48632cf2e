"""Suffix-array dedup: repeated byte strings by a common-prefix-aware, distributed merge sort.

A string is ``LENGTH`` bytes of one text's UTF-8. Its *anchor* is the run of ``ANCHOR`` bytes in it
with the smallest hash (the leftmost of equals), so equal strings have their anchor at the same
place, and only suffixes that start at an anchor need sorting: a sparse suffix array, of which each
entry stands for the consecutive strings that share the anchor.

1. Texts are packed into buckets by id. Each bucket sends the distinct 40-bit hashes of its anchors
   to the hash's bucket, which sends back those that occur in two documents or more. This only
   thins the suffixes: an anchor that one document alone has is in no repeated string.
2. Each bucket sorts its remaining suffixes (cut after ``LENGTH`` bytes) and front-codes them: each
   sends only what it doesn't share with the one before. Such runs go to the bucket of the anchor.
   Suffixes with equal surroundings are settled within the bucket: only the smallest document's
   travels, so a string in a third of all documents is sent once for each bucket of texts. The others
   are known to repeat it; their ranges go back to their own bucket of texts and never meet the rest.
3. A loser tree merges the runs. It knows each contender's common prefix with the last winner: the
   longer one wins without a look at the bytes, and only equals are compared, beyond what is known.
   The merge yields the common prefix of neighbours, so suffixes that agree on ``x`` bytes are the
   stretches between drops below ``x``. The bytes in front of the anchors are sorted and cut in the
   same way; for each distance to the anchor the two stretches name the string exactly, and the
   smallest document of each name decides.
4. Covered ranges return to the buckets of texts, which report what is left.

A bucket of texts sends one packed row to each bucket of hashes or runs that it has something for.
There are far fewer of those than of texts (``HASH_BYTES``, ``MERGE_BYTES`` against
``BUCKET_BYTES``), and never more rows than anchors.

Edge cases: null and empty texts have no bytes; a null id is in no match and keeps its text whole;
strings repeated within one document, or between rows with one id, don't remove anything; rows that
repeat an id are taken to repeat its text; of documents with one string only the smallest id keeps
it, so ties don't arise; long texts stay whole; empty tables give an empty
result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import bytework as bw
from loam.session import shuffle_width

LENGTH = 50
ANCHOR = 24
BUCKET_BYTES = 4_000_000  # of texts, sorted by a task at a time
HASH_BYTES = 64_000_000  # of texts behind a bucket of anchor hashes
MERGE_BYTES = 16_000_000  # of texts behind a bucket of runs
PIECE = 500_000
LOW = np.uint64((1 << 24) - 1)
SPAN = 1 << 23
TEXTS = "<i8 <u1 <i8 ."
RUN = "<u1 . <i4 <i8 <i8 <u1 <u1 . <i8 <i8 <i8"
_none = lambda *kinds: [b"" if k == "." else np.zeros(0, k) for k in kinds]
NO_RUN, NO_RANGES = _none(*RUN.split()[:8]), _none(*RUN.split()[8:])


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (bw.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _pack(buckets: int):
    """mapInArrow: texts packed by the bucket of their id."""

    def run(batches):
        for batch in batches:
            ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            bucket = bucket_of(ids, buckets)
            order = np.argsort(bucket, kind="stable")
            text = batch.column(1)
            held, rows_b, rows_p = [], [], []

            def flush():
                t = [(text[i].as_py() or "").encode("utf-8", "surrogatepass") for i in held]
                rows_b.append(int(bucket[held[0]]))
                rows_p.append(bw.pack(ids[held].astype("<i8"), null[held].astype("<u1"), np.array([len(x) for x in t], "<i8"), b"".join(t)))
                held.clear()

            for i in order.tolist():
                if held and bucket[i] != bucket[held[0]]:
                    flush()
                held.append(i)
            if held:
                flush()
            yield pa.record_batch([pa.array(rows_b, pa.int32()), pa.array(rows_p, pa.binary())], names=["bucket", "payload"])

    return run


def _texts(table: pa.Table):
    """(ids, null flags, texts) of a bucket, payload by payload."""
    for p in table.column("payload"):
        ids, null, size, data = bw.unpack(p.as_py(), TEXTS)
        edge = np.r_[0, np.cumsum(size)].tolist()
        yield ids, null, [data[a:b] for a, b in zip(edge, edge[1:])]


def pieces(table: pa.Table):
    """(ids, bytes, starts) of documents with an id, about ``PIECE`` bytes at a time; a space follows each text."""
    ids, texts, n = [], [], 0
    for own, null, data in _texts(table):
        for i, gone, t in zip(own.tolist(), null.tolist(), data):
            if gone or len(t) < LENGTH:
                continue
            ids.append(i), texts.append(t)
            n += len(t) + 1
            if n >= PIECE:
                yield _joined(ids, texts)
                ids, texts, n = [], [], 0
    if texts:
        yield _joined(ids, texts)


def _joined(ids, texts):
    return np.array(ids, np.int64), np.frombuffer(b" ".join(texts) + b" ", np.uint8), np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)


def leftmost_least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every ``width`` consecutive hashes, the place of the smallest 40-bit hash (the leftmost of equals), and that hash.

    A hash and its place share a 64-bit key, so places are counted anew in spans of less than ``1 << 24``.
    """
    places, hashes = [], []
    for begin in range(0, max(0, len(h) - width + 1), SPAN):
        part = h[begin : begin + SPAN + width - 1]
        step, least = 1, (part & ~LOW) | np.arange(len(part), dtype=np.uint64)
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        places.append((least & LOW).astype(np.int64) + begin)
        hashes.append(least >> np.uint64(24))
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.uint64), *hashes])


def anchors(data: np.ndarray, starts: np.ndarray):
    """(place, 40-bit hash, first string, strings, document) of every anchor's run of strings."""
    h = bw.Slices(data)(np.arange(len(data) - ANCHOR + 1), np.arange(ANCHOR, len(data) + 1))
    least_place, least_hash = leftmost_least(h, LENGTH - ANCHOR + 1)
    count = np.maximum(np.diff(starts) - LENGTH, 0)  # a text of n bytes has n - LENGTH + 1 strings
    doc, nth = bw.ragged(count)
    at = starts[doc] + nth
    place = least_place[at]
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])] if len(at) else np.zeros(0, bool)
    run = np.diff(np.r_[np.flatnonzero(new), len(at)])
    return place[new], least_hash[at[new]], at[new], run, doc[new]


def _hashes(targets: int):
    """applyInArrow: the bucket's distinct anchor hashes, with a flag for those of several documents."""

    def run(table: pa.Table) -> pa.Table:
        hashes, docs = [], []
        for ids, data, starts in pieces(table):
            _, h, _, _, doc = anchors(data, starts)
            hashes.append(h), docs.append(ids[doc])
        out = pa.schema([("target", pa.int32()), ("source", pa.int32()), ("payload", pa.binary())])
        if not hashes:
            return out.empty_table()
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.minimum.reduceat(d, cuts) != np.maximum.reduceat(d, cuts)
        h = h[cuts]
        target = (bw.mix(h) % np.uint64(targets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        h, many, target = h[order], many[order], target[order]
        at = np.r_[np.flatnonzero(np.diff(target, prepend=-1)), len(target)]
        rows = [bw.pack(np.diff(h[a:b], prepend=np.uint64(0)).astype("<u8"), many[a:b].astype("<u1")) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.table([pa.array(target[at[:-1]], pa.int32()), pa.array(np.full(len(rows), table.column("bucket")[0].as_py(), np.int32)), pa.array(rows, pa.binary())], schema=out)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """applyInArrow: for each source bucket, its hashes that several documents of the corpus have."""
    parts = [bw.unpack(p.as_py(), "<u8 <u1") for p in table.column("payload")]
    hashes = [np.cumsum(h, dtype=np.uint64) for h, _ in parts]
    h, many = np.concatenate(hashes), np.concatenate([m for _, m in parts]).astype(bool)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    keep = np.zeros(len(h), bool)
    keep[order] = np.r_[False, same] | np.r_[same, False] | many[order]
    edge = np.r_[0, np.cumsum([len(x) for x in hashes])].tolist()
    rows = [bw.pack(h[a:b][keep[a:b]].astype("<u8")) for a, b in zip(edge, edge[1:])]
    return pa.table({"bucket": table.column("source"), "payload": pa.array(rows, pa.binary())})


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each row with the one before, and the bytes that it adds."""
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return shared, rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes()


def front_decode(shared: np.ndarray, added: bytes, width: int) -> np.ndarray:
    rows = np.zeros((len(shared), width), np.uint8)
    rows[np.arange(width) >= shared[:, None]] = np.frombuffer(added, np.uint8)
    index = np.arange(len(shared))
    for j in range(width):  # a byte that is shared comes from the last row that brought one
        rows[:, j] = rows[np.maximum.accumulate(np.where(shared <= j, index, 0)), j]
    return rows


def merge_runs(values: list[list[int]], shared: list[list[int]], width: int) -> tuple[list[int], list[int]]:
    """Loser tree over sorted runs of ``width``-byte numbers: the run of each output, and its common
    prefix with the output before.

    ``shared[r][i]`` is the common prefix of value ``i`` of run ``r`` with the one before it. Each
    loser keeps its common prefix with the winner that beat it; on the way up the longer prefix
    wins, and equals are compared on the bytes beyond it.
    """
    n = len(values)
    size = 1 << max(1, (n - 1).bit_length())
    now = [v[0] if v else 0 for v in values] + [0] * (size - n)
    pre = [0 if v else -1 for v in values] + [-1] * (size - n)
    at = [0] * size
    mask = [(1 << 8 * (width - i)) - 1 for i in range(width + 1)]
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        if pre[a] != pre[b]:
            return (a, b) if pre[a] > pre[b] else (b, a)
        if pre[a] < 0:
            return a, b
        m = mask[pre[a]]
        x, y = now[a] & m, now[b] & m
        if y < x:
            a, b = b, a
        pre[b] = width - ((x ^ y).bit_length() + 7) // 8
        return a, b

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    w = winners[1]
    out_run, out_pre = [], []
    while pre[w] >= 0:
        out_run.append(w)
        out_pre.append(pre[w])
        at[w] += 1
        if at[w] < len(values[w]):
            now[w], pre[w] = values[w][at[w]], shared[w][at[w]]
        else:
            pre[w] = -1
        node, p = (size + w) >> 1, pre[w]
        while node:
            other = loser[node]
            q = pre[other]
            if q > p:
                loser[node], w, p = w, other, q
            elif q == p and p >= 0:
                m = mask[p]
                x, y = now[w] & m, now[other] & m
                common = width - ((x ^ y).bit_length() + 7) // 8
                if y < x:
                    pre[w] = common
                    loser[node], w = w, other
                else:
                    pre[other] = common
            node >>= 1
    return out_run, out_pre


LEFT = LENGTH - ANCHOR


def _runs(targets: int):
    """cogrouped: a bucket's suffixes at repeated anchors, sorted, settled and front-coded, by the anchor's bucket."""
    out_schema = pa.schema([("target", pa.int32()), ("payload", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [bw.unpack(p.as_py(), "<u8")[0] for p in right.column("payload")] if right.num_rows else []
        known = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        if not len(known) or not left.num_rows:
            return out_schema.empty_table()
        held: list[tuple] = []
        for ids, data, starts in pieces(left):
            place, h, first, count, doc = anchors(data, starts)
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[k] == h)
            if not len(hit):
                continue
            place, h, first, count, doc = place[hit], h[hit], first[hit], count[hit], doc[hit]
            far, near = place - first, place - first - count + 1  # the strings start so many bytes before the anchor
            wide = np.r_[np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)]
            view = np.lib.stride_tricks.sliding_window_view(wide, LENGTH + LEFT)
            around = view[place]
            ahead = np.where(np.arange(LENGTH) < (LENGTH - near)[:, None], around[:, LEFT:], 0)
            behind = np.where(np.arange(LEFT) < far[:, None], around[:, LEFT - 1 :: -1] if LEFT else around[:, :0], 0)
            held.append((np.concatenate([ahead, behind, near[:, None], far[:, None]], 1).astype(np.uint8), h, ids[doc], (place - starts[doc]).astype(np.int64)))
        if not held:
            return out_schema.empty_table()
        rows, h, doc, place = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
        rows, h, doc, place = rows[order], h[order], doc[order], place[order]
        new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]
        cuts = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(doc, cuts), np.diff(np.r_[cuts, len(doc)]))
        gone = doc > least
        target = (bw.mix(h) % np.uint64(targets)).astype(np.int64)
        t_out, p_out = [], []
        live = np.flatnonzero(~gone)
        live = live[np.argsort(target[live], kind="stable")]  # by target once, in order within each
        edge = np.r_[np.flatnonzero(np.diff(target[live], prepend=-1)), len(live)]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            m = live[lo:hi]
            t = int(target[m[0]])
            ahead = rows[m, :LENGTH]
            fresh = np.r_[True, (ahead[1:] != ahead[:-1]).any(axis=1)] if len(m) else np.zeros(0, bool)
            at = np.flatnonzero(fresh)
            shared, added = front_code(ahead[at])
            t_out.append(t)
            near, far = rows[m, -2], rows[m, -1]
            p_out.append(bw.pack(shared.astype("<u1"), added, np.diff(np.r_[at, len(m)]).astype("<i4"), doc[m].astype("<i8"), place[m].astype("<i8"), near.astype("<u1"), far.astype("<u1"), rows[m, LENGTH:-2].tobytes(), *NO_RANGES))
        g = np.flatnonzero(gone)
        if len(g):  # decided: they go home, by their own key
            near, far = rows[g, -2].astype(np.int64), rows[g, -1].astype(np.int64)
            t_out.append(targets + left.column("bucket")[0].as_py())
            p_out.append(bw.pack(*NO_RUN, doc[g].astype("<i8"), (place[g] - far).astype("<i8"), (place[g] - near + LENGTH).astype("<i8")))
        return pa.table([pa.array(t_out, pa.int32()), pa.array(p_out, pa.binary())], schema=out_schema)

    return run


def _judge(buckets: int):
    """applyInArrow: merge the runs of an anchor bucket and name the strings that smaller documents have."""

    def run(table: pa.Table) -> pa.Table:
        values, shared, group_sizes = [], [], []
        cols: list[list] = [[], [], [], [], []]
        gone: list[list] = [[], [], []]
        for p in table.column("payload"):
            pre, added, size, doc, place, near, far, behind, *settled = bw.unpack(p.as_py(), RUN)
            ahead = front_decode(pre.astype(np.int64), added, LENGTH)
            raw = ahead.tobytes()
            values.append([int.from_bytes(raw[i : i + LENGTH], "big") for i in range(0, len(raw), LENGTH)])
            shared.append(pre.tolist())
            group_sizes.append(size.astype(np.int64))
            for c, v in zip(cols, (doc, place.astype(np.int64), near.astype(np.int64), far.astype(np.int64), np.frombuffer(behind, np.uint8).reshape(-1, LEFT))):
                c.append(v)
            for c, v in zip(gone, settled):
                c.append(v)
        doc, place, near, far, behind = (np.concatenate(c) for c in cols)
        out_doc, out_a, out_b = (np.concatenate(c).astype(np.int64) for c in gone)
        run_of, pre = merge_runs(values, shared, LENGTH)
        values.clear()
        if run_of:
            # the k-th output of run r is its k-th group; groups lie one after the other in the columns
            order = np.argsort(np.array(run_of), kind="stable")
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order))
            sizes = np.concatenate(group_sizes)
            begin = np.cumsum(sizes) - sizes
            group, inner = bw.ragged(sizes[nth])
            entry = begin[nth][group] + inner
            doc, place, near, far, behind = doc[entry], place[entry], near[entry], far[entry], behind[entry]
            pre = np.array(pre)
            back = np.argsort(np.ascontiguousarray(behind).view(f"V{LEFT}").ravel(), kind="stable")
            back_pre = front_code(behind[back])[0]
            for o in range(LEFT + 1):
                mine = np.flatnonzero((near <= o) & (o <= far))
                if len(mine) < 2:
                    continue
                ahead_name = np.cumsum(pre < LENGTH - o)[group[mine]]
                behind_name = np.empty(len(doc), np.int64)
                behind_name[back] = np.cumsum(back_pre < o)
                name = ahead_name * (len(doc) + 1) + behind_name[mine]
                by = np.argsort(name, kind="stable")
                cuts = np.flatnonzero(np.r_[True, name[by][1:] != name[by][:-1]])
                least = np.repeat(np.minimum.reduceat(doc[mine[by]], cuts), np.diff(np.r_[cuts, len(by)]))
                hit = mine[by][least < doc[mine[by]]]
                out_doc = np.r_[out_doc, doc[hit]]
                out_a, out_b = np.r_[out_a, place[hit] - o], np.r_[out_b, place[hit] - o + LENGTH]
        # ranges of one document put together
        order = np.lexsort((out_a, out_doc))
        d, a, b = out_doc[order], out_a[order], out_b[order]
        if len(d):
            rank = np.searchsorted(np.unique(d), d)
            reach = np.maximum.accumulate(b + rank * (1 << 40)) - rank * (1 << 40)
            new = np.r_[True, (d[1:] != d[:-1]) | (a[1:] > reach[:-1])]
            at = np.flatnonzero(new)
            d, a, b = d[at], a[at], np.r_[reach[at[1:] - 1], reach[-1:]]
        home = bucket_of(d, buckets)
        order = np.argsort(home, kind="stable")
        home, d, a, b = home[order], d[order], a[order], b[order]
        at = np.r_[np.flatnonzero(np.diff(home, prepend=-1)), len(home)]
        rows = [bw.pack(d[i:j].astype("<i8"), a[i:j].astype("<i8"), b[i:j].astype("<i8")) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.table({"bucket": pa.array(home[at[:-1]], pa.int32()), "payload": pa.array(rows, pa.binary())})

    return run


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges put together, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digest(left: pa.Table, right: pa.Table) -> pa.Table:
    """cogrouped: texts of a bucket without the ranges that go."""
    parts = [bw.unpack(p.as_py(), "<i8 <i8 <i8") for p in right.column("payload")]
    d, a, b = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64) for _ in range(3))
    order = np.argsort(d, kind="stable")
    d, a, b = d[order], a[order], b[order]
    out: list[list] = [[], [], [], [], []]
    for ids, null, texts in _texts(left):
        lo, hi = np.searchsorted(d, ids, "left").tolist(), np.searchsorted(d, ids, "right").tolist()
        for i, gone, text, x, y in zip(ids.tolist(), null.tolist(), texts, lo, hi):
            spans = covered(list(zip(a[x:y].tolist(), b[x:y].tolist()))) if y > x and not gone else []
            at, kept = 0, hashlib.sha256()
            for p, q in spans:
                kept.update(text[at:p])
                at = q
            kept.update(text[at:])
            for c, v in zip(out, (None if gone else i, len(text), sum(q - p for p, q in spans), len(spans), kept.hexdigest())):
                c.append(v)
    return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_bytes": pa.array(out[1], pa.int64()), "n_removed": pa.array(out[2], pa.int64()), "n_spans": pa.array(out[3], pa.int64()), "kept_sha256": pa.array(out[4], pa.string())})


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = shuffle_width(docs.sparkSession)
    buckets, hashed, merged = (max(width, total // size + 1) for size in (BUCKET_BYTES, HASH_BYTES, MERGE_BYTES))
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(buckets), "bucket int, payload binary")
    sent = packed.groupBy("bucket").applyInArrow(_hashes(hashed), "target int, source int, payload binary")
    known = sent.groupBy("target").applyInArrow(_repeated, "bucket int, payload binary")
    runs = packed.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_runs(merged), "target int, payload binary")
    ranges = runs.groupBy("target").applyInArrow(_judge(buckets), "bucket int, payload binary")
    return packed.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
