"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Components become integers, ``floor(256 * x)``. Rows are dealt into blocks by a hash of their id.
A block's index orders each dimension's postings by value and cuts them into segments of equal
*quantised* value; the width of a level follows the dimension's range and the block's rows
(``SEGMENT_ROWS``), and is one where there are enough of them, so that nothing is lost. For a query,
a segment's impact is the query's component times its best value; all segments of all dimensions are
processed by descending impact (more exactly: by the gain over the dimension's worst value, in
``LEVELS`` steps), and each adds its quantised impact to its rows' accumulators.

At up to ``CHECKS`` points of the way each row's score is known to lie between its accumulator and the
accumulator plus, for each dimension in which the row hasn't been met, the impact of that
dimension's next segment, and plus the width of the levels in which it has. The first point follows
the share of postings that the block's other queries have needed. The ``TRIED`` most
promising rows are scored there, and the k-th best of those scores is a bound that the result can't
stay under. Processing stops only on proof: when few rows (``RESCORE``) can still reach the bound, or
nothing is left. All rows that can are rescored exactly, so the result is exact whatever the stop.

The k-th best score that a worker has proved for a query in one block is a threshold for its next
blocks. Queries come in blocks too; a pair of blocks is one group of bounded size, and each gives k
rows a query at most, which are merged by a ranking. There are only as many blocks of queries as make
``PAIRS`` pairs or hold ``MOST_QUERIES`` each, and at most ``MOST_TASKS`` tasks, so what is shuffled and what
the driver keeps of tasks stay small. Work grows with queries times rows, as it must for an exact
answer: packed queries travel once to each block of rows, and a block of rows to each block of queries.

Edge cases: vectors that are null or hold null or non-finite components take no part; vectors of
different lengths are compared on their common components; ties go to the smaller id; a query's own
id is never its result; a query id that repeats counts once, a candidate that repeats counts as
often as it occurs; null ids take no part; empty tables give an empty result; further input columns
are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import bytework as bw

SCALE = 256
BLOCK_ROWS = 8192
BLOCK_QUERIES = 512
MOST_QUERIES = 16_384
PAIRS = 200
SEGMENT_ROWS = 2
RESCORE = 64
TRIED = 24
CHECKS = 9
FIRST = 0.3  # of the postings, which are read before the first check at least
NEAR = 0.08  # checks begin by so much before the share of postings that the block's queries have read so far
LEVELS = 1023
COMPRESS = 16  # bounds are formed for the rows still possible alone once they are this few a part of all
MOST_TASKS = 1_000
_PROVED: dict[str, dict[int, int]] = {}


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v``: the valid vectors as integers."""
    x = F.col(vector_col)
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return rows.where(F.col(id_col).isNotNull() & x.isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """List column as rows of equal width, short ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(column.offsets.to_numpy())
    width = int(lens.max(initial=0)) if width is None else width
    out = np.zeros((len(lens), width), np.int64)
    row, place = bw.ragged(lens.astype(np.int64))
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def build_index(table: pa.Table) -> pa.Table:
    """A block's index: ids, values by dimension in descending order, and the rows in that order."""
    ids = table.column("id").to_numpy()
    m = matrix(table.column("v"))
    by_dim = m.T.copy()
    order = np.argsort(-by_dim, axis=1, kind="stable")
    payload = bw.pack(np.array(m.shape, "<i8"), ids.astype("<i8"), np.take_along_axis(by_dim, order, 1).astype("<i8"), order.astype("<u4"))
    return pa.table({"block": table.column("block")[:1], "payload": pa.array([payload], pa.binary())})


def pack_queries(table: pa.Table) -> pa.Table:
    m = matrix(table.column("v"))
    payload = bw.pack(np.array(m.shape, "<i8"), table.column("id").to_numpy().astype("<i8"), m.astype("<i8"))
    return pa.table({"block": table.column("block")[:1], "payload": pa.array([payload], pa.binary())})


class BlockIndex:
    """The unpacked index of a block, with its segments."""

    def __init__(self, payload: bytes):
        shape, self.ids, values, order = bw.unpack(payload, "<i8 <i8 <i8 <u4")
        self.n, self.d = int(shape[0]), int(shape[1])
        self.values, self.order = values.reshape(self.d, self.n), order.reshape(self.d, self.n).astype(np.int64)
        self.rows = np.zeros((self.n, self.d), np.int64)
        for k in range(self.d):
            self.rows[self.order[k], k] = self.values[k]
        spread = self.values[:, :1] - self.values[:, -1:] + 1 if self.n else np.ones((self.d, 1), np.int64)
        bits = np.maximum(0, np.ceil(np.log2(np.maximum(1, spread * SEGMENT_ROWS / max(1, self.n))))).astype(np.int64)
        level = self.values >> bits
        new = np.ones((self.d, self.n), bool)
        new[:, 1:] = level[:, 1:] != level[:, :-1]
        dim, _ = np.nonzero(new)
        flat = np.flatnonzero(new)
        self.dim, self.size = dim, np.diff(np.r_[flat, self.d * self.n])  # of the segments of the flattened postings
        self.segment = np.searchsorted(dim, np.arange(self.d + 1))  # a dimension's first one
        self.upto = np.r_[flat, self.d * self.n]  # postings before a segment
        top, low = self.values.ravel()[flat], self.values.ravel()[flat + self.size - 1]
        self.most, self.least = (self.values[:, 0], self.values[:, -1]) if self.n else (np.zeros(self.d, np.int64),) * 2
        self.above, self.below = top - self.least[dim], self.most[dim] - low  # a segment's best, for weights above and below 0
        self.wide = np.zeros(self.d, np.int64)
        np.maximum.at(self.wide, dim, top - low)
        # what each posting is sure to gain for a unit of weight above 0, and below
        kind = np.float32 if int(spread.max(initial=0)) < 1 << 24 else np.float64  # exact either way
        self.posted = [np.repeat(low - self.least[dim], self.size).astype(kind), np.repeat(self.most[dim] - top, self.size).astype(kind)]
        self.flat = self.order.ravel()
        self.rank = np.empty((self.d, self.n), np.uint16 if self.n < 1 << 16 else np.int64)  # a row's place in each dimension
        np.put_along_axis(self.rank, self.order, np.arange(self.n, dtype=self.rank.dtype)[None, :], 1)
        # memory that all queries use again
        self.held, self.met = (np.empty(self.d * self.n, np.int64), np.empty(self.d * self.n)), np.empty((self.d, self.n), np.float32)
        self.read = self.rescored = self.asked = 0
        self.share = FIRST  # of the postings that queries have read, on average

    def search(self, q: np.ndarray, k: int, theta: int | None, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best for ``q``, with exact scores; all that reach ``theta`` or the k-th best."""
        d, n = min(self.d, len(q)), self.n
        weight = np.zeros(self.d, np.int64)
        weight[:d] = q[:d]
        hidden = self.ids == own
        up, force, count = weight > 0, np.abs(weight), np.diff(self.segment)
        gain = np.where(np.repeat(up, count), self.above, self.below) * np.repeat(force, count)
        best = int(gain.max(initial=0))
        # impacts in levels; at level 0 are worst values, which the base counts
        level = np.ceil(gain * (LEVELS / max(1, best))).astype(np.int64)
        base = float((weight * np.where(up, self.least, self.most)).sum())
        read = np.cumsum(np.bincount(level, self.size, LEVELS + 2)[:0:-1])  # postings of this level and the ones above it, from the highest
        wanted = np.linspace(max(FIRST, self.share - NEAR), 1, CHECKS) * read[-1]
        stops = np.unique(np.searchsorted(read, wanted)) if best else ()
        lower = np.full(n, base)
        lower[hidden] = -np.inf
        enough = n - int(hidden.sum()) >= k
        need = -np.inf if theta is None else float(theta)
        slack = (force * self.wide).astype(np.float32)  # what a row met in a dimension may have beyond its quantised impact
        side = np.where(up, 1, -1).astype(np.float32)
        edge = np.arange(self.d) * n
        done, taken = 0, np.zeros(self.d, np.int64)
        value, scored = np.zeros(n, np.int64), np.zeros(n, bool)
        alive = np.flatnonzero(~hidden)  # a row that can't reach the bound never will: bounds fall, what is needed grows

        def exact(rows: np.ndarray) -> np.ndarray:
            fresh = rows[~scored[rows]]
            value[fresh], scored[fresh] = self.rows[fresh, :d] @ q[:d], True
            self.rescored += len(fresh)
            return value[rows]

        for stop in [None, *stops]:
            passed = np.zeros(self.d, np.int64)
            if stop is not None:
                passed = np.add.reduceat(level > LEVELS - stop, self.segment[:-1], dtype=np.int64)
                total = np.where(up, self.upto[self.segment[:-1] + passed] - edge, edge + n - self.upto[self.segment[1:] - passed])
                # the step's segments of a dimension lie side by side, from its upper end or its lower one
                more = total - taken
                begin = np.where(up, edge + taken, edge + n - total)
                parts = [(slice(x, x + m), f, 0 if u else 1) for x, m, f, u in zip(begin.tolist(), more.tolist(), force.tolist(), up.tolist()) if m]
                if parts:
                    m = int(more.sum())
                    rows, gained = self.held[0][:m], self.held[1][:m]
                    np.concatenate([self.flat[p] for p, _, _ in parts], out=rows)
                    np.concatenate([self.posted[u][p] for p, _, u in parts], out=gained)
                    gained *= np.repeat(force, more)
                    lower += np.bincount(rows, gained, n)
                taken, done = total, int(total.sum())
            next_ = np.clip(np.where(up, self.segment[:-1] + passed, self.segment[1:] - 1 - passed), 0, max(0, len(gain) - 1))
            left = np.where(passed < count, gain[next_], 0).astype(np.float32) if len(gain) else np.zeros(self.d, np.float32)
            # a row is met in a dimension if its place is among the ones taken
            places = self.rank if len(alive) * COMPRESS > n else self.rank[:, alive]
            known = self.met[:, : places.shape[1]]
            np.less(places, np.where(up, taken, n - taken)[:, None].astype(places.dtype), out=known, casting="unsafe")
            change = left - slack
            bound = (change * side) @ known + float(change[~up].sum())
            upper = lower[alive] + float(left.sum()) - (bound[alive] if places is self.rank else bound) + 1e-5 * (1 + float(left.sum()) + float(slack.sum()))
            if enough and done:  # the most promising rows are scored: their k-th best is a sure bound
                near = alive[np.argpartition(lower[alive] + upper, -min(len(alive), TRIED))[-TRIED:]] if len(alive) else alive
                if len(near) >= k:
                    need = max(need, float(np.partition(exact(near), -k)[-k]))
            alive = alive[upper >= need]
            if len(alive) <= RESCORE:
                break
        self.read += done
        if len(read) and read[-1]:
            self.asked += 1
            self.share += (done / read[-1] - self.share) / min(self.asked, 16)
        return self.ids[alive], exact(alive)


def score_pairs(k: int, run_id: str):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        proved = _PROVED.get(run_id)
        if proved is None:
            _PROVED.clear()
            proved = _PROVED[run_id] = {}
        out_q, out_v, out_s = [[np.zeros(0, np.int64)] for _ in range(3)]
        if index.num_rows and queries.num_rows:
            block = BlockIndex(index.column("payload")[0].as_py())
            shape, qids, m = bw.unpack(queries.column("payload")[0].as_py(), "<i8 <i8 <i8")
            if len(proved) > 1_000_000:  # thresholds only save work
                proved.clear()
            for qid, q in zip(qids.tolist(), m.reshape(int(shape[0]), int(shape[1]))):
                ids, scores = block.search(q, k, proved.get(qid), qid)
                best = np.lexsort((ids, -scores))[:k]
                out_q.append(np.full(len(best), qid)), out_v.append(ids[best]), out_s.append(scores[best])
                if len(best) == k:
                    proved[qid] = max(proved.get(qid, np.iinfo(np.int64).min), int(scores[best[-1]]))
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return run


def query_blocks(n_queries: int, blocks: int) -> int:
    """As few as the bound on a block's queries allows, but enough pairs for many tasks while blocks have ``BLOCK_QUERIES``."""
    return max(1, -(-n_queries // MOST_QUERIES), min(-(-n_queries // BLOCK_QUERIES), -(-PAIRS // blocks)))


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of ``rows`` for each of ``queries`` (both ``id, v``)."""
    n_rows, n_queries = rows.count(), queries.count()
    blocks = max(1, -(-n_rows // BLOCK_ROWS))
    q_blocks = query_blocks(n_queries, blocks)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    index = dealt.groupBy("block").applyInArrow(build_index, "block int, payload binary")
    asked = queries.dropDuplicates(["id"]).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"))
    packed = asked.groupBy("block").applyInArrow(pack_queries, "block int, payload binary")
    tasks = min(MOST_TASKS, 4 * blocks * q_blocks)  # more than pairs, as few pairs should share one

    def side(df: DataFrame, block, q_block):
        return df.select(block.alias("block"), q_block.alias("q_block"), "payload").repartition(tasks, "block", "q_block").groupBy("block", "q_block")

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = side(index, F.col("block"), each(q_blocks)).cogroup(side(packed, each(blocks), F.col("block")))
    found = pairs.applyInArrow(score_pairs(k, uuid.uuid4().hex), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
