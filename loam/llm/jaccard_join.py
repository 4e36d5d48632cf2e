"""N-gram Jaccard join over prefix trees: linked documents and their components, exactly.

A document's set holds the hashes of its distinct word n-grams (56 bits; two given sets of 500
n-grams share a hash by chance with odds of 500 * 500 / 2**56). Documents link if
``den * |x & y| >= num * |x | y|``.

1. *Classes.* Documents with equal sets (128-bit sums of the hashes, and the size) form a class;
   its smallest id represents it. Copies go no further.
2. *Global order.* n-grams are ordered by (number of documents, hash): the rarest come first. The
   representatives' n-grams are counted in two exchanges. The first sends each n-gram of a chunk
   once, with its count there, and finds the *hot* ones, of at least ``T`` documents; ``T`` grows
   with the corpus, so at most ``HOT_MAX`` are hot and can be broadcast. The second sends the others
   with their documents to the n-gram's bucket, which counts them exactly and passes on what two or
   more documents have; hot ones go with their document and never meet in one bucket.
3. *Edges of the trie.* Of two linked sets, the first ``p`` n-grams of each share one (``p`` from the
   size and the threshold). An n-gram that one document alone has leads nowhere and comes first in
   the order, so a document with ``p`` of those links with nothing: most go here. What is left of a
   set is its ordered list of shared n-grams; the first ``k`` of them are its entry nodes.
4. *Forests.* Every document goes to one entry node, its most populated, in blocks of at most
   ``BLOCK``. A block stores its sets in a prefix tree. Sets are probed against the tree, level by
   level: an edge's n-grams are compared once for all sets that share it, the partial overlap goes
   on to the children, and a subtree is left as soon as the overlap so far and the best of its
   remaining lengths can't reach what the sizes ask. Documents already in one component aren't
   probed against each other again. Where a node has several blocks, one document for each
   component of each block goes on to the next round, until all meet in a block.
5. *What is left.* A node whose documents are all in one component needs no further look. In the
   others, documents outside the node's largest component are compared with all, by sizes, by the
   lengths beyond the shared n-gram, and by *parity bitmaps* (each n-gram flips a bit; two bitmaps
   differ in no more bits than the sets differ in elements). Pairs that this allows are probed as
   above, centre by centre: first the ``CLOSEST`` of a document with each other component, then all
   between components that are still apart. So a large group of copies, or of documents that nearly
   link, doesn't give all its pairs, and no link between components is lost.

Edge cases: null and empty texts, and texts without words, have an empty set, link with nothing and
are their own component; fewer words than ``n`` make one n-gram; a null id has a null component;
rows that repeat an id are taken to repeat its text; ties don't arise, as a component is named by its
smallest id; long texts stay whole; empty tables give an empty result; further input columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import bytework as bw
from loam.llm.components import components
from loam.session import cut, shuffle_width

HOT_LEAST = 64
HOT_MAX = 500_000
BROADCAST_IDS = 1_000_000
BUCKET_BYTES = 8_000_000  # of texts behind a bucket of n-grams
CHUNK_BYTES = 2_000_000
BLOCK = 500  # documents of a node that are probed in one tree
PAIR_BLOCK = 4000  # documents of a node that are compared by their lengths in one task
CELL_BYTES = 6_000_000  # of sets behind a task's blocks
MEMBERS = 1000
PARITY = 1024  # bits of a set's parity bitmap
CLOSEST = 2  # pairs of a document with each other component that are tried first
EDGE = 64  # n-grams of an edge of the tree, at most
SHORT = np.uint64(16)  # the first exchange names an n-gram by 40 bits of the 56
NAME = np.uint64(8)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def sets_of(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of the distinct n-grams of a chunk, by document and hash; and the set sizes."""
    docs = len(starts) - 1
    low = LOWER[data]
    begin, end = bw.word_bounds(low)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    doc = np.searchsorted(starts, begin, "right") - 1
    words = np.bincount(doc, minlength=docs)
    first = np.cumsum(words) - words
    grams = bw.Slices(bw.Slices(low)(begin, end))
    i = np.arange(max(0, len(begin) - n + 1))
    i = i[doc[i] == doc[i + n - 1]]
    short = np.flatnonzero((words > 0) & (words < n))
    h = np.r_[grams(i, i + n), grams(first[short], first[short] + words[short])] >> NAME
    d = np.r_[doc[i], short]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    return d[new], h[new], np.bincount(d[new], minlength=docs)


def _signatures(n: int):
    """mapInArrow: (doc_id, n, s1, s2): the set's size and two sums over its hashes."""

    def run(batches):
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            size, one, two = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            for rows, data, starts in bw.chunks([pa.record_batch([ids, batch.column(1)], names=["i", "t"])]):
                _, h, count = sets_of(data, starts, n)
                size[rows] = count
                edge = np.r_[0, np.cumsum(count)]
                for to, values in ((one, bw.mix(h)), (two, bw.mix(h + np.uint64(77)) | np.uint64(1))):
                    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]
                    to[rows] = sums[edge[1:]] - sums[edge[:-1]]
            yield pa.record_batch([batch.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", "n", "s1", "s2"])

    return run


def _ranges(upper: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The buckets of sorted numbers of so many bits, by range, and the stretch of each."""
    bucket = (upper * np.uint64(buckets) >> np.uint64(bits)).astype(np.int64)
    at = np.r_[np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)]
    return bucket[at[:-1]], list(zip(at[:-1].tolist(), at[1:].tolist()))


def _counts(n: int, buckets: int):
    """mapInArrow: how many documents of a chunk have each n-gram, by hash range."""

    def of_chunk(data, starts):
        token, count = np.unique(sets_of(data, starts, n)[1] >> SHORT, return_counts=True)
        bucket, parts = _ranges(token >> np.uint64(8), 32, buckets)
        rows = [bw.pack(np.diff(token[a:b], prepend=np.uint64(0)).astype("<u8"), count[a:b].astype("<u4")) for a, b in parts]
        return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "payload"])

    def run(batches):
        for _, data, starts in bw.chunks(batches, CHUNK_BYTES):
            yield of_chunk(data, starts)

    return run


def _hot(least: int):
    """applyInArrow: the n-grams of a range that ``least`` documents have."""

    def run(table: pa.Table) -> pa.Table:
        parts = [bw.unpack(p.as_py(), "<u8 <u4") for p in table.column("payload")]
        token = np.concatenate([np.cumsum(t, dtype=np.uint64) for t, _ in parts])
        count = np.concatenate([c for _, c in parts]).astype(np.int64)
        order = np.argsort(token, kind="stable")
        token, count = token[order], count[order]
        cuts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        total = np.add.reduceat(count, cuts)
        keep = total >= least
        return pa.table({"token": pa.array(token[cuts][keep].astype(np.int64)), "df": pa.array(total[keep])})

    return bw.trimmed(run)


def order_key(token: np.ndarray, df: np.ndarray, hot: bool) -> np.ndarray:
    """63 bits that follow the global order: counts up to 99, then the hot ones by the count's logarithm."""
    step = 64 + np.ceil(np.log2(np.maximum(df, 1))).astype(np.uint64) if hot else np.minimum(df, 63).astype(np.uint64)
    return (step << np.uint64(56)) | token


def prefix_size(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many first n-grams of a set any linked set must meet: n - ceil(num * n / den) + 1."""
    return size - (num * size + den - 1) // den + 1


POST = "<u8 <u4 <i8 <i8 <i8 <i4 <u8"


def _posts(n: int, hot, buckets: int):
    """mapInArrow: by bucket, n-grams with their documents (those that aren't hot, dealt by range), and
    sizes and hot n-grams of documents (dealt by document)."""

    def of_chunk(ids, data, starts, names, counts):
        d, h, size = sets_of(data, starts, n)
        at = np.minimum(np.searchsorted(names, h >> SHORT), max(0, len(names) - 1))
        flag = (names[at] == h >> SHORT) if len(names) else np.zeros(len(h), bool)
        plain = np.flatnonzero(~flag)
        plain = plain[np.argsort(h[plain], kind="stable")]
        token, doc = h[plain], d[plain]
        sent: dict[int, list] = {}
        for b, (i, j) in zip(*(lambda x: (x[0].tolist(), x[1]))(_ranges(token >> np.uint64(24), 32, buckets))):
            own, index = np.unique(doc[i:j], return_inverse=True)
            sent[b] = [np.diff(token[i:j], prepend=np.uint64(0)).astype("<u8"), index.astype("<u4"), np.diff(ids[own], prepend=0).astype("<i8")]
        keys = order_key(h[flag], counts[at[flag]], True) if len(names) else h[flag]
        held = np.bincount(d[flag], minlength=len(size))
        edge = np.r_[0, np.cumsum(held)]
        has = np.flatnonzero(size)
        home = (bw.mix(ids[has].astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(home).tolist():
            mine = has[home == b]
            group, inner = bw.ragged(held[mine])
            sent.setdefault(b, [np.zeros(0, "<u8"), np.zeros(0, "<u4"), np.zeros(0, "<i8")]).extend([ids[mine].astype("<i8"), size[mine].astype("<i8"), held[mine].astype("<i4"), keys[edge[mine][group] + inner].astype("<u8")])
        none = [np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(0, "<i4"), np.zeros(0, "<u8")]
        rows = [bw.pack(*(x if len(x) == 7 else x + none)) for x in sent.values()]
        return pa.record_batch([pa.array(list(sent), pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "payload"])

    def run(batches):
        names, counts = hot.value
        for ids, data, starts in bw.chunks(batches, CHUNK_BYTES):
            yield of_chunk(ids, data, starts, names, counts)

    return run


SHARED = "<i8 <i4 <u8 <i8 <i8 <i4 <u8"


def _shared(homes: int):
    """applyInArrow: count a bucket's n-grams; those of several documents go to the documents' homes."""

    def run(table: pa.Table) -> pa.Table:
        token, doc, ids, size, held, keys = ([] for _ in range(6))
        for p in table.column("payload"):
            t, index, own, i, s, c, k = bw.unpack(p.as_py(), POST)
            token.append(np.cumsum(t, dtype=np.uint64)), doc.append(np.cumsum(own)[index] if len(own) else own)
            ids.append(i), size.append(s), held.append(c), keys.append(k)
        token, doc, ids, size, held, keys = (np.concatenate(x) for x in (token, doc, ids, size, held, keys))
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])] if len(token) else np.zeros(0, bool)
        token, doc = token[new], doc[new]
        cuts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        df = np.repeat(np.diff(np.r_[cuts, len(token)]), np.diff(np.r_[cuts, len(token)]))
        many = df > 1
        key, doc = order_key(token[many], df[many], False), doc[many]
        home_of = lambda x: (bw.mix(x.view(np.uint64) + np.uint64(5)) % np.uint64(homes)).astype(np.int64)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        home, own_home = home_of(doc), home_of(ids)
        edge = np.r_[0, np.cumsum(held)].astype(np.int64)
        by, own_by = np.argsort(home, kind="stable"), np.argsort(own_home, kind="stable")  # by home once, in order within each
        key, doc, home, own_home = key[by], doc[by], home[by], own_home[own_by]
        present = np.union1d(home, own_home)
        ends = [np.searchsorted(x, present, side).tolist() for x in (home, own_home) for side in ("left", "right")]
        rows = []
        for b, lo, hi, own_lo, own_hi in zip(present.tolist(), *ends):
            own = own_by[own_lo:own_hi]
            docs, count = np.unique(doc[lo:hi], return_counts=True)
            group, inner = bw.ragged(held[own])
            rows.append((b, bw.pack(np.diff(docs, prepend=0).astype("<i8"), count.astype("<i4"), key[lo:hi].astype("<u8"), ids[own], size[own], held[own], keys[edge[own][group] + inner])))
        return pa.table({"home": pa.array([b for b, _ in rows], pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())})

    return bw.trimmed(run)


def parity(keys: np.ndarray) -> bytes:
    """A bitmap that each n-gram flips a bit of: two differ in no more bits than the sets in elements."""
    odd = np.bincount((keys & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _candidates(num: int, den: int):
    """applyInArrow: (doc, n, k, keys, bits): documents that can link, their shared n-grams in order, and those' parity."""

    def run(table: pa.Table) -> pa.Table:
        doc, key, ids, size = [], [], [], []
        for p in table.column("payload"):
            own, count, k, i, s, held, hot = bw.unpack(p.as_py(), SHARED)
            doc += [np.repeat(np.cumsum(own), count), np.repeat(i, held)]
            key += [k, hot]
            ids.append(i), size.append(s)
        doc, key, ids, size = (np.concatenate(x) for x in (doc, key, ids, size))
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
        doc, key = doc[new], key[new]
        ids, at = np.unique(ids, return_index=True)
        size = size[at]
        lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
        k = prefix_size(size, num, den) - (size - (hi - lo))
        can = np.flatnonzero(k > 0)
        packed = [bw.pack(key[a:b].astype("<u8")) for a, b in zip(lo[can].tolist(), hi[can].tolist())]
        maps = [parity(key[a:b]) for a, b in zip(lo[can].tolist(), hi[can].tolist())]
        return pa.table({"doc": pa.array(ids[can]), "n": pa.array(size[can]), "k": pa.array(k[can].astype(np.int32)), "keys": pa.array(packed, pa.binary()), "bits": pa.array(maps, pa.binary())})

    return bw.trimmed(run)


def _entries(batches):
    """mapInArrow: (key, doc, n, at, rest) of the entry nodes; ``at`` shared n-grams come before, ``rest`` after."""
    for batch in batches:
        doc, n, k = (batch.column(c).to_numpy() for c in ("doc", "n", "k"))
        keys, rest = [np.zeros(0, "<u8")], [np.zeros(0, np.int64)]
        for p, count in zip(batch.column("keys"), k.tolist()):
            own = bw.unpack(p.as_py(), "<u8")[0]
            keys.append(own[:count])
            rest.append(len(own) - 1 - np.arange(count))
        group, at = bw.ragged(k.astype(np.int64))
        columns = [np.concatenate(keys).astype(np.int64), doc[group], n[group], at.astype(np.int32), np.concatenate(rest).astype(np.int32)]
        yield pa.record_batch([pa.array(c) for c in columns], names=["key", "doc", "n", "at", "rest"])


class PrefixTree:
    """Ordered sets in a tree of shared prefixes, probed level by level with partial overlaps.

    A node stands for up to ``EDGE`` consecutive n-grams of the sets below it. A member ends at one
    node. ``top`` of a node is the largest ``(num + den) * length - num * size`` of the members
    below, where ``length`` counts a member's listed n-grams and ``size`` all of them: at a depth
    ``l`` with an overlap ``o``, a member can reach a set of size ``n`` only if
    ``(num + den) * (o - l) + top >= num * n``.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int):
        self.num, self.den, self.sizes = num, den, np.asarray(sizes, np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        self.words, ids = np.unique(flat, return_inverse=True)
        edge = np.r_[0, np.cumsum([len(s) for s in sets])]
        self.ids = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        parent, start, stop, end_of, owner = [], [], [], np.zeros(len(sets), np.int64), []
        stack: list[int] = []
        before = None
        for i in order:
            own = self.ids[i]
            shared = 0
            if before is not None:
                m = min(len(own), len(before))
                differ = np.flatnonzero(own[:m] != before[:m])
                shared = int(differ[0]) if len(differ) else m
            while stack and start[stack[-1]] >= shared and (shared or stack):
                stack.pop()
            while True:
                upto = min(len(own), shared + EDGE)
                parent.append(stack[-1] if stack else -1), start.append(shared), stop.append(upto), owner.append(i)
                stack.append(len(parent) - 1)
                shared = upto
                if upto == len(own):
                    break
            end_of[i] = len(parent) - 1
            before = own
        self.parent, self.start, self.stop = (np.array(x, np.int64) for x in (parent, start, stop))
        self.member_at, self.end_of = np.argsort(end_of, kind="stable"), end_of
        length = np.array([len(s) for s in sets], np.int64)
        lowest = -(1 << 60)
        self.top = np.full(len(parent), lowest)
        self.small, self.large = np.full(len(parent), 1 << 60), np.zeros(len(parent), np.int64)
        np.maximum.at(self.top, end_of, (num + den) * length - num * self.sizes)
        np.minimum.at(self.small, end_of, self.sizes)
        np.maximum.at(self.large, end_of, self.sizes)
        for node in range(len(parent) - 1, -1, -1):
            p = parent[node]
            if p >= 0:
                self.top[p] = max(self.top[p], self.top[node])
                self.small[p], self.large[p] = min(self.small[p], self.small[node]), max(self.large[p], self.large[node])
        self.flat = np.concatenate([np.zeros(0, np.int64), *[self.ids[i][a:b] for i, a, b in zip(owner, start, stop)]])
        self.begin = np.r_[0, np.cumsum(self.stop - self.start)]
        self.child = np.argsort(self.parent, kind="stable")
        self.first_child = np.searchsorted(self.parent[self.child], np.arange(-1, len(parent) + 1))
        self.first_member = np.searchsorted(end_of[self.member_at], np.arange(len(parent) + 1))

    def probe(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all links of some members with all members, themselves left out."""
        num, den = self.num, self.den
        marks = np.zeros((len(queries), len(self.words)), bool)
        for row, q in enumerate(queries.tolist()):
            marks[row, self.ids[q]] = True
        size = self.sizes[queries]
        roots = self.child[self.first_child[0] : self.first_child[1]]
        q, node = np.repeat(np.arange(len(queries)), len(roots)), np.tile(roots, len(queries))
        have = np.zeros(len(q), np.int64)
        found_q, found_m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(q):
            alive = (num + den) * (have - self.start[node]) + self.top[node] >= num * size[q]
            alive &= (den * self.large[node] >= num * size[q]) & (den * size[q] >= num * self.small[node])
            q, node, have = q[alive], node[alive], have[alive]
            if not len(q):
                break
            group, inner = bw.ragged(self.stop[node] - self.start[node])
            hit = marks[q[group], self.flat[self.begin[node][group] + inner]]
            sums = np.r_[0, np.cumsum(hit)]
            first = np.r_[0, np.cumsum(self.stop[node] - self.start[node])]
            overlap = have + sums[first[1:]] - sums[first[:-1]]
            ends, nth = bw.ragged(self.first_member[node + 1] - self.first_member[node])
            member = self.member_at[self.first_member[node][ends] + nth]
            ok = (num + den) * overlap[ends] >= num * (size[q[ends]] + self.sizes[member])
            ok &= member != queries[q[ends]]
            found_q.append(queries[q[ends][ok]]), found_m.append(member[ok])
            above, nth = bw.ragged(self.first_child[node + 2] - self.first_child[node + 1])
            child = self.child[self.first_child[node + 1][above] + nth]
            within = self.start[child] - self.start[node][above]
            have = have[above] + sums[first[:-1][above] + within] - sums[first[:-1][above]]
            q, node = q[above], child
        return np.concatenate(found_q), np.concatenate(found_m)


def forest(tree: PrefixTree) -> list[tuple[int, int]]:
    """Links that join the members' components, one for each step; few probes first, then more at a time."""
    root = list(range(len(tree.sizes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, at, width = [], 0, 1
    order = np.argsort(-tree.sizes, kind="stable")
    while at < len(order):
        if len({find(i) for i in range(len(root))}) == 1:
            break
        a, b = tree.probe(order[at : at + width])
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[rx] = ry
                out.append((x, y))
        at += width
        width = min(64, 2 * width)
    return out


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [bw.unpack(p.as_py(), "<u8")[0] for p in table.column("keys")]


def _groups(*columns: np.ndarray):
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    at = np.r_[np.flatnonzero(new), len(order)].tolist()
    return [order[a:b] for a, b in zip(at[:-1], at[1:])]


def _forests(num: int, den: int):
    """applyInArrow: links that join what each (key, block) holds."""

    def run(table: pa.Table) -> pa.Table:
        key, block, doc, n = (table.column(c).to_numpy() for c in ("key", "block", "doc", "n"))
        sets, a, b = _sets(table), [], []
        for own in _groups(key, block):
            own = own[np.unique(doc[own], return_index=True)[1]]
            if len(own) > 1:
                for x, y in forest(PrefixTree([sets[i] for i in own.tolist()], n[own], num, den)):
                    a.append(int(doc[own[x]])), b.append(int(doc[own[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return bw.trimmed(run)


def _stars(num: int, den: int):
    """applyInArrow: the partners that link with each centre, ``home``."""

    def run(table: pa.Table) -> pa.Table:
        home, salt, doc, n = (table.column(c).to_numpy() for c in ("home", "salt", "doc", "n"))
        sets, a, b = _sets(table), [], []
        for own in _groups(home, salt):
            own = own[np.unique(doc[own], return_index=True)[1]]
            centre = np.flatnonzero(doc[own] == home[own])
            if len(centre) and len(own) > 1:
                _, m = PrefixTree([sets[i] for i in own.tolist()], n[own], num, den).probe(centre)
                a += [int(home[own[0]])] * len(m)
                b += doc[own[m]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return bw.trimmed(run)


def _allowed(num: int, den: int, most: int | None):
    """applyInArrow: pairs of a node's cell, minor by any, of different components, that their sizes, the
    lengths before and after the shared n-gram and their parities allow; with ``most`` only so many
    of a document with each component, those whose parities are nearest."""

    def run(table: pa.Table) -> pa.Table:
        key, u, v, side, doc, n, at, rest, root = (table.column(c).to_numpy() for c in ("key", "u", "v", "side", "doc", "n", "at", "rest", "root"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(doc), PARITY // 64)
        alone = n - at - rest - 1  # n-grams that no other document has
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own in _groups(key, u, v):
            one, all_ = own[side[own] == 0], own[side[own] == 1]
            for x in one.tolist():
                y = all_[root[all_] != root[x]]
                reach = 1 + np.minimum(at[y], at[x]).astype(np.int64) + np.minimum(rest[y], rest[x])
                y = y[(num + den) * reach >= num * (n[y] + n[x])]
                both = n[y] + n[x]
                lack = both - 2 * ((num * both + num + den - 1) // (num + den)) - alone[y] - alone[x]
                differ = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1)
                y, differ = y[differ <= lack], differ[differ <= lack]
                if most is not None and len(y) > most:
                    order = np.lexsort((differ, root[y]))
                    y = y[order]
                    _, nth = bw.ragged(np.unique(root[y], return_counts=True)[1])
                    y = y[nth < most]
                a.append(np.minimum(doc[y], doc[x])), b.append(np.maximum(doc[y], doc[x]))
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        return pa.table({"a": pa.array(a[new]), "b": pa.array(b[new])})

    return bw.trimmed(run)


def counted_join(left: DataFrame, right: DataFrame, on: list[str], count: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and say in ``count`` how many rows of
    ``left`` they meet: large groups by broadcast (at most 100,000 of them), the others by a shuffle."""
    large = max(1000, rows // 100_000)
    hot = F.broadcast(right.where(F.col(count) >= large))
    rest = left.join(hot.select(*on), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(right.where(F.col(count) < large), on, how))


def _block_count(column: str, size: int):
    return F.ceil(F.col(column) / F.lit(size)).cast("int")


class Join:
    """One join's tables: ``sets`` (doc, n, k, keys, bits) and the entry nodes that several documents share."""

    def __init__(self, sets: DataFrame, num: int, den: int):
        self.num, self.den, self.sets = num, den, sets
        spark = sets.sparkSession
        self.width = shuffle_width(spark)
        of_all = sets.agg(F.count("*"), F.sum(F.octet_length("keys"))).first()
        self.mean = (of_all[1] or 0) / max(1, of_all[0])
        entries = cut(sets.mapInArrow(_entries, "key long, doc long, n long, at int, rest int"))
        nodes = entries.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1")
        self.entries = cut(counted_join(entries, cut(nodes), ["key"], "docs", entries.count()))

    def cells(self, rows: int) -> int:
        return max(min(self.width, 64), int(rows * self.mean / CELL_BYTES) + 1)

    def forests(self, dealt: DataFrame) -> DataFrame:
        """``dealt(key, block, doc)``: links within the blocks."""
        rows = dealt.count()
        wanted = F.broadcast(dealt) if rows <= BROADCAST_IDS else dealt
        placed = self.sets.select("doc", "n", "keys").join(wanted, "doc").withColumn("cell", F.pmod(F.xxhash64("key", "block"), F.lit(self.cells(rows))))
        return cut(placed.groupBy("cell").applyInArrow(_forests(self.num, self.den), "a long, b long"))

    def rooted(self, roots: DataFrame) -> DataFrame:
        """The entries with the component of each document."""
        named = roots.select(F.col("id").alias("doc"), "root")
        return cut(self.entries.join(named, "doc", "left").withColumn("root", F.coalesce("root", "doc")))

    def first_links(self) -> tuple[DataFrame, DataFrame]:
        """Links of the forests, and the components that they make."""
        best = self.entries.groupBy("doc").agg(F.max(F.struct("docs", "key")).alias("x"))
        dealt = cut(best.select("x.key", "doc", _block_count("x.docs", BLOCK).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")))
        links = self.forests(dealt.select("key", "block", "doc"))
        roots = components(links)
        many = cut(dealt.where("blocks > 1").select("key", "doc"))
        while not many.isEmpty():
            named = roots.select(F.col("id").alias("doc"), "root")
            pivots = many.join(named, "doc", "left").groupBy("key", F.coalesce("root", "doc").alias("root")).agg(F.min("doc").alias("doc"))
            counts = cut(pivots.groupBy("key").agg(F.count("*").alias("left")).where("left > 1"))
            next_ = cut(counted_join(cut(pivots), counts, ["key"], "left", many.count()).select("key", "doc", _block_count("left", BLOCK).alias("blocks")))
            found = self.forests(next_.select("key", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), "doc"))
            if found.isEmpty():
                break
            links = cut(links.union(found))
            roots = components(links)
            many = cut(next_.where("blocks > 1").select("key", "doc"))
        return links, roots

    def pairs_left(self, roots: DataFrame, most: int | None) -> DataFrame:
        """Pairs between components that share a node and that lengths and parities allow."""
        rooted = self.rooted(roots)
        parts = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
        mixed = cut(parts.groupBy("key").agg(F.sum("c").alias("docs"), F.max(F.struct("c", "root")).alias("x"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("docs").alias("members"), F.col("x.root").alias("major"), (F.col("docs") - F.col("x.c")).alias("minors")))
        held = cut(counted_join(rooted.drop("docs"), mixed, ["key"], "members", self.entries.count())).join(self.sets.select("doc", "bits"), "doc")
        blocks = held.withColumn("us", _block_count("minors", PAIR_BLOCK)).withColumn("vs", _block_count("members", PAIR_BLOCK))
        own = lambda s: F.pmod(F.xxhash64("doc"), F.col(s)).cast("int")
        every = lambda s: F.explode(F.sequence(F.lit(0), F.col(s) - 1))
        carried = ["key", "doc", "n", "at", "rest", "root", "bits"]
        one = blocks.where("root != major").select(*carried, F.lit(0).alias("side"), own("us").alias("u"), every("vs").alias("v"))
        all_ = blocks.select(*carried, F.lit(1).alias("side"), own("vs").alias("v"), every("us").alias("u"))
        cells = max(min(self.width, 64), int(self.entries.count() // 200_000) + 1)
        dealt = one.unionByName(all_).withColumn("cell", F.pmod(F.xxhash64("key", "u", "v"), F.lit(cells)))
        return cut(dealt.groupBy("cell").applyInArrow(_allowed(self.num, self.den, most), "a long, b long").distinct())

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that link: partners meet at the smaller id, in slices of ``MEMBERS``."""
        slices = cut(pairs.groupBy("a").agg(F.count("*").alias("partners")))
        sliced = counted_join(pairs, slices, ["a"], "partners", pairs.count()).withColumn("slices", _block_count("partners", MEMBERS))
        members = sliced.select(F.col("a").alias("home"), F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("salt"), F.col("b").alias("doc"))
        centres = slices.select(F.col("a").alias("home"), F.explode(F.sequence(F.lit(0), _block_count("partners", MEMBERS) - 1)).alias("salt"), F.col("a").alias("doc"))
        asked = cut(members.union(centres))
        rows = asked.count()
        placed = self.sets.select("doc", "n", "keys").join(F.broadcast(asked) if rows <= BROADCAST_IDS else asked, "doc").withColumn("cell", F.pmod(F.xxhash64("home", "salt"), F.lit(self.cells(rows))))
        return cut(placed.groupBy("cell").applyInArrow(_stars(self.num, self.den), "a long, b long"))

    def components(self) -> DataFrame:
        links, roots = self.first_links()
        for most in (CLOSEST, None):
            pairs = self.pairs_left(roots, most)
            if pairs.isEmpty():
                break
            found = self.linked(pairs)
            if not found.isEmpty():
                links = cut(links.union(found))
                roots = components(links)
        return roots


def candidate_sets(texts: DataFrame, total: int, grams: int, n: int, num: int, den: int) -> DataFrame:
    """(doc, n, k, keys, bits) of the documents that can link, from ``texts(doc_id, text)``, one for each class."""
    spark = texts.sparkSession
    buckets = max(min(shuffle_width(spark), 64), total // BUCKET_BYTES + 1)
    least = max(HOT_LEAST, grams // HOT_MAX + 1)
    hot = texts.mapInArrow(_counts(n, buckets), "bucket int, payload binary").groupBy("bucket").applyInArrow(_hot(least), "token long, df long")
    found = sorted((r["token"], r["df"]) for r in hot.toLocalIterator())  # at most HOT_MAX
    shared = spark.sparkContext.broadcast((np.array([t for t, _ in found], np.uint64), np.array([c for _, c in found], np.int64)))
    homes = max(min(shuffle_width(spark), 16), buckets // 4)
    posted = texts.mapInArrow(_posts(n, shared, buckets), "bucket int, payload binary")
    counted = posted.groupBy("bucket").applyInArrow(_shared(homes), "home int, payload binary")
    return cut(counted.groupBy("home").applyInArrow(_candidates(num, den), "doc long, n long, k int, keys binary, bits binary"))


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    sets = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_signatures(n), "doc_id long, n long, s1 long, s2 long")
    rows = cut(sets)
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = cut(named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    sums = rows.agg(F.count("*"), F.sum("n")).first()
    n_rows, grams = sums[0], sums[1] or 0
    member = counted_join(named, classes.where("members > 1"), ["n", "s1", "s2"], "members", n_rows)
    copies = cut(member.where(F.col("doc_id") != F.col("rep")).select("doc_id").distinct())
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    texts = texts.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti")
    roots = Join(candidate_sets(texts, total, grams, n, num, den), num, den).components()
    named_by = classes.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    moved = cut(named_by.where((F.col("members") > 1) | (F.col("root") != F.col("rep"))).select("n", "s1", "s2", "members", "root"))
    reach = counted_join(rows, moved, ["n", "s1", "s2"], "members", n_rows, "left")
    return reach.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def dedup(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document, the smallest id, of each component; all columns stay.

    Of rows that repeat the kept id, each different text stays once. Rows with a null id can't be told
    apart and all stay.
    """
    judged = cut(join(docs.select("doc_id", "text"), n, num, den).where("doc_id is not null"))
    gone = cut(judged.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    # texts stay where they are while the ids of one side are few enough (counted) for a broadcast
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    left = docs.join(few(gone), "doc_id", "left_anti")  # a null id equals none
    repeated = cut(judged.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return left.select(*docs.columns)
    ids = few(repeated)
    again = left.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(ids, "doc_id", "left_anti").unionByName(again).select(*docs.columns)
