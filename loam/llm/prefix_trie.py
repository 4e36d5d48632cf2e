"""The trie of conversations that share first turns.

A conversation is *rebuilt* as the first ``h`` turns of its base followed by its own turns after its
first ``h``; the base and ``h`` follow from its id. A node is a sequence of first turns that some
rebuilt conversation starts with; the smallest conversation that does owns it.

1. Turns are dealt by ranges of (conversation, turn), so a conversation of any length spans tasks.
   Each task numbers its turns and runs a polynomial digest of 2 x 64 bits over them; where a
   conversation continues in the next task, the earlier part's count and digest are added there.
   The digest of any sequence of a rebuilt conversation follows from those of its two sources.
2. The minima: for each (depth, prefix digest) the smallest conversation, and how many there are.
3. If a conversation owns a depth, it owns all deeper ones. A binary search finds the first one: in
   each round all conversations that aren't settled look up their middle depth's minimum in one
   batch. Only minima of several conversations need a look, others are owned. Minima that a
   ``1 / HOT_SHARE`` of all turns meet are few and go by broadcast, the rest by shuffle.
4. The owned depths of a conversation form a chain, and the last depth before them says which node of
   which chain it hangs on: chains are the tree.
5. Chains are summed bottom-up by doubling: in round ``k`` a chain adds what its descendants ``2**k``
   chains below have gathered, and then looks twice as far. Sums along a chain run within blocks of
   ``BLOCK`` depths and over the blocks' totals.
6. The ids that end at a node are sorted by ranges, so a node with many copies spans tasks; each
   gives strings of ``CHUNK`` ids, which are hashed in order as a stream.

Edge cases: rows with a null conv_id take no part; a null role or text is empty; turns that tie (null
or repeated ones) go by the SHA-256 of ``length:role text``; repeated rows are turns of their own; a
conversation whose base is absent loses its own first ``h`` turns; one that is left without turns
is a member of the root alone; texts of any length are hashed whole and don't travel; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.session import cut, shuffle_width

GROUP = 20
MOST_SHARED = 3
HOT_SHARE = 2000
BLOCK = 4096
CHUNK = 1024
BROADCAST_ROWS = 200_000
WORDS = r"[^\x20\x09-\x0D]+"
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F)  # any two odd numbers
_FULL = (1 << 64) - 1


def shared_turns(conv_id: Column) -> Column:
    """``h``: how many turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % GROUP


def powers(base: int, n: np.ndarray) -> np.ndarray:
    """``base ** n`` modulo 2**64 for each ``n >= 0``."""
    out, square = np.ones(len(n), np.uint64), base
    left = n.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] *= np.uint64(square)
        square, left = square * square & _FULL, left >> 1
    return out


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words``: all that is needed of a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), digest.alias("by"))


def _numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, piece, l, s0, s1, words``: place and running digests of each turn within its task's part of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, conv, count, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
        for b in batches:
            c = b.column(0).to_numpy()
            if not len(c):
                continue
            first = np.r_[True, c[1:] != c[:-1]]
            start = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            l = np.arange(len(c)) - start[group] + 1  # noqa: E741
            carried = group == 0 if conv == c[0] else np.zeros(len(c), bool)
            l[carried] += count
            h = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(-1, 2)
            runs = []
            for k in range(2):
                term = h[:, k] * powers(_BASES[k], l)
                total = np.cumsum(term)
                s = total - (total[start] - term[start])[group]
                s[carried] += np.uint64(sums[k])
                runs.append(s)
            conv, count, sums = c[-1], int(l[-1]), [int(s[-1]) for s in runs]
            yield pa.record_batch([b.column(0), pa.array(np.full(len(c), piece, np.int32)), pa.array(l), *(pa.array(s.view(np.int64)) for s in runs), b.column(2)], names=["conv_id", "piece", "l", "s0", "s1", "words"])

    salted = turns.withColumn("salt", F.monotonically_increasing_id())  # rows that repeat can be parted as well
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("by"), F.col("salt")]
    dealt = salted.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "digest", "words").mapInArrow(run, "conv_id long, piece int, l long, s0 long, s1 long, words long")


def positions(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, p0, p1, words``: each turn's place in its conversation and the digests of the turns up to it."""
    rows = cut(_numbered(turns))
    spans = rows.groupBy("conv_id").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a < b").select("conv_id")
    # a task's part has two conversations that go beyond it at most, its first and its last
    last = F.max(F.struct("l", "s0", "s1")).alias("m")
    parts = rows.join(F.broadcast(spans), "conv_id").groupBy("conv_id", "piece").agg(last).select("conv_id", "piece", "m.*").collect()
    before: dict[tuple[int, int], tuple[int, int, int]] = {}
    conv, at = None, (0, 0, 0)
    for r in sorted(parts, key=lambda r: (r["conv_id"], r["piece"])):
        if r["conv_id"] != conv:
            conv, at = r["conv_id"], (0, 0, 0)
        before[conv, r["piece"]] = at
        at = (at[0] + r["l"], *((at[k + 1] + pow(_BASES[k], at[0], 1 << 64) * (r[f"s{k}"] & _FULL)) & _FULL for k in range(2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, piece, pos = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().copy()
            s = [b.column(3 + k).to_numpy().view(np.uint64).copy() for k in range(2)]
            edge = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (piece[1:] != piece[:-1])]) if len(c) else []
            for i, j in zip(edge, [*edge[1:], len(c)]):
                if known := before.get((int(c[i]), int(piece[i]))):
                    pos[i:j] += known[0]
                    for k in range(2):
                        s[k][i:j] = s[k][i:j] * np.uint64(pow(_BASES[k], known[0], 1 << 64)) + np.uint64(known[k + 1])
            yield pa.record_batch([b.column(0), pa.array(pos), *(pa.array(x.view(np.int64)) for x in s), b.column(5)], names=["conv_id", "pos", "p0", "p1", "words"])

    return rows.mapInArrow(run, "conv_id long, pos long, p0 long, p1 long, words long")


def rebuilt(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``conv_id, length`` of every rebuilt conversation; ``conv_id, length, depth, d0, d1, words`` of its turns)."""
    heads = [F.max(F.when(F.col("pos") == i, F.struct("p0", "p1", "words"))).alias(f"t{i}") for i in range(1, MOST_SHARED + 1)]
    facts = cut(places.groupBy("conv_id").agg(F.max("pos").alias("n"), *heads))
    h = shared_turns(F.col("conv_id"))
    own = facts.select("conv_id", "n", h.alias("h"), base_of(F.col("conv_id")).alias("base"), *[F.struct(f"t{i}.p0", f"t{i}.p1").alias(f"o{i}") for i in range(1, MOST_SHARED + 1)])
    bases = facts.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *[f"t{i}" for i in range(1, MOST_SHARED + 1)])
    zero = F.struct(F.lit(0).cast("long").alias("p0"), F.lit(0).cast("long").alias("p1"))
    at = lambda n, name: F.coalesce(*[F.when(n == i, F.struct(F.col(f"{name}{i}.p0").alias("p0"), F.col(f"{name}{i}.p1").alias("p1"))) for i in range(1, MOST_SHARED + 1)], zero)
    met = own.join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int"))
    convs = cut(
        met.select(
            "conv_id", "h", "b",
            (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
            at(F.col("b"), "t").alias("q"), at(F.col("h"), "o").alias("o"),
            F.array(*[F.struct(F.lit(i).cast("long").alias("depth"), f"t{i}.p0", f"t{i}.p1", f"t{i}.words") for i in range(1, MOST_SHARED + 1)]).alias("taken"),
        )
    )
    taken = convs.where("b > 0").select("conv_id", "length", F.explode(F.slice("taken", F.lit(1), F.col("b"))).alias("t")).select("conv_id", "length", "t.depth", F.col("t.p0").alias("d0"), F.col("t.p1").alias("d1"), "t.words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The base's digest, then the own turns' moved by the difference of the two lengths."""
        back = [pow(x, -1, 1 << 64) for x in _BASES]
        for b in batches:
            col = {n: b.column(i).to_numpy() for i, n in enumerate(b.schema.names)}
            lost = (col["h"] - col["b"]).astype(np.int64)
            d = []
            for k in range(2):
                moved = (col[f"p{k}"].view(np.uint64) - col[f"o{k}"].view(np.uint64)) * powers(back[k], lost)
                d.append((col[f"q{k}"].view(np.uint64) + moved).view(np.int64))
            yield pa.record_batch([pa.array(x) for x in (col["conv_id"], col["length"], col["pos"] - lost, *d, col["words"])], names=["conv_id", "length", "depth", "d0", "d1", "words"])

    # one conversation may hold many turns; its row on the other side is single, so a skewed join splits it
    later = places.join(convs.select("conv_id", "length", "h", "b", "q", "o"), "conv_id").where(F.col("pos") > F.col("h"))
    later = later.select("conv_id", "length", "h", "b", "pos", "p0", "p1", F.col("q.p0").alias("q0"), F.col("q.p1").alias("q1"), F.col("o.p0").alias("o0"), F.col("o.p1").alias("o1"), "words")
    turns = taken.unionByName(later.mapInArrow(run, "conv_id long, length long, depth long, d0 long, d1 long, words long"))
    return convs.select("conv_id", "length"), turns


def minima(turns: DataFrame) -> DataFrame:
    """``depth, d0, d1, owner, length, n_convs, words`` of every node below the root: its smallest conversation and that one's length."""
    least = F.min(F.struct("conv_id", "length")).alias("m")
    return turns.groupBy("depth", "d0", "d1").agg(least, F.count("*").alias("n_convs"), F.min("words").alias("words")).select("depth", "d0", "d1", F.col("m.conv_id").alias("owner"), "m.length", "n_convs", "words")


def first_owned(convs: DataFrame, turns: DataFrame, nodes: DataFrame, root_owner: int) -> DataFrame:
    """``conv_id, length, first, above``: the first depth that a conversation owns, and the owner of the depth before.

    ``first`` is ``length + 1`` where it owns none. The root's owner is left out.
    """
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    shared = nodes.where("n_convs > 1").select("depth", "d0", "d1", "owner", (F.col("n_convs") * HOT_SHARE >= total).alias("hot"))
    hot, cold = F.broadcast(shared.where("hot").drop("hot")), shared.where("not hot").drop("hot")  # n_convs sum up to total: HOT_SHARE rows at most
    key = ["depth", "d0", "d1"]
    state = cut(convs.where(F.col("conv_id") != root_owner).select("conv_id", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"), F.lit(root_owner).cast("long").alias("above")))
    settled = None
    while True:
        done, open_ = state.where("lo >= hi"), state.where("lo < hi")
        settled = done if settled is None else settled.unionByName(done)
        n = open_.count()
        if not n:
            return settled.select("conv_id", "length", F.col("lo").alias("first"), "above")
        asked = open_.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long"))
        small = n <= BROADCAST_ROWS
        probes = turns.select("conv_id", *key).join(F.broadcast(asked) if small else asked, ["conv_id", "depth"])
        at_hot = probes.join(hot.withColumnRenamed("owner", "hot_owner"), key, "left")
        known, rest = at_hot.where("hot_owner is not null"), at_hot.where("hot_owner is null").drop("hot_owner")
        met = known.withColumnRenamed("hot_owner", "owner").unionByName(rest.join(cold, key, "left"))
        owns = F.coalesce(F.col("owner"), F.col("conv_id")) == F.col("conv_id")
        state = cut(
            met.select(
                "conv_id", "length",
                F.when(owns, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"),
                F.when(owns, F.col("depth")).otherwise(F.col("hi")).alias("hi"),
                F.when(owns, F.col("above")).otherwise(F.col("owner")).alias("above"),
            )
        )


def chain_sums(chains: DataFrame) -> DataFrame:
    """``id, parent, saved, leaves`` with both summed over each chain's descendants and itself, by doubling."""
    state, n = cut(chains.select("id", F.col("parent").alias("up"), "saved", "leaves")), None
    while True:
        hanging = state.where("up is not null")
        given = cut(hanging.groupBy("up").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count("*").alias("n")))
        if given.isEmpty():
            return chains.select("id", "parent").join(state.drop("up"), "id")
        n = n or hanging.count()
        # ancestors of many chains are few, and go by broadcast
        often = given.where(F.col("n") * HOT_SHARE >= n).select(F.col("up").alias("id"))
        ups = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        frequent = cut(state.join(F.broadcast(often), "id", "left_semi").select(F.col("id").alias("up"), F.col("up").alias("often_next"), F.lit(True).alias("often")))
        marked = state.join(F.broadcast(frequent), "up", "left")
        moved = marked.where("often").select("id", F.col("often_next").alias("next"), "saved", "leaves")
        others = marked.where("often is null").select("id", "up", "saved", "leaves").join(ups, "up", "left").select("id", "next", "saved", "leaves")
        added = given.select(F.col("up").alias("id"), "more_saved", "more_leaves")
        new = moved.unionByName(others).join(added, "id", "left")
        state = cut(new.select("id", F.col("next").alias("up"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")))


def end_digests(ends: DataFrame) -> DataFrame:
    """``owner, depth, ends_sha256`` of ``ends(owner, depth, conv_id)``: ids in ascending order, comma-joined."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []

        def row():
            return pa.record_batch([pa.array([at[0]]), pa.array([at[1]]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["owner", "depth", "least", "ids"])

        for b in batches:
            out = []
            for o, d, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if ids and (at != (o, d) or len(ids) == CHUNK):
                    out.append(row())
                    ids = []
                at = (o, d)
                ids.append(c)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            out = []
            for o, d, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if at == (o, d):
                    h.update(b",")
                else:
                    if at:
                        out.append((*at, h.hexdigest()))
                    at, h = (o, d), hashlib.sha256()
                h.update(text.encode())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["owner", "depth", "ends_sha256"])
        if at:
            yield pa.record_batch([pa.array([at[0]]), pa.array([at[1]]), pa.array([h.hexdigest()])], names=["owner", "depth", "ends_sha256"])

    key, width = ["owner", "depth"], shuffle_width(ends.sparkSession)
    sorted_ = ends.select(*key, "conv_id").repartitionByRange(width, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    packed = sorted_.mapInArrow(strings, "owner long, depth long, least long, ids string")
    return packed.repartition(*key).sortWithinPartitions(*key, "least").select(*key, "ids").mapInArrow(hashed, "owner long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = conversations.sparkSession
    places = cut(positions(turn_rows(conversations)))
    convs, turns = rebuilt(places)
    convs = cut(convs)
    root = convs.agg(F.min(F.struct("conv_id", "length")).alias("m"), F.count("*").alias("n")).first()
    if not root["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    top = root["m"]["conv_id"]
    turns = cut(turns)
    below = cut(minima(turns))
    owned = cut(first_owned(convs, turns, below, top))
    nodes = below.select("owner", "depth", "length", "n_convs", "words").unionByName(spark.createDataFrame([(top, 0, root["m"]["length"], root["n"], 0)], "owner long, depth long, length long, n_convs long, words long"))
    key = ["owner", "depth"]

    chained = owned.where(F.col("first") <= F.col("length"))
    hung = chained.select(F.col("conv_id").alias("id"), F.col("above").alias("parent"), (F.col("first") - 1).alias("at"))
    hooks = hung.groupBy(F.col("parent").alias("owner"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"))
    weight = (F.col("n_convs") - 1) * F.col("words")
    goes_on = F.col("depth") < F.col("length")
    local = cut(nodes.join(hooks, key, "left").withColumn("hung", F.coalesce("hung", F.lit(0))).select(*key, "n_convs", weight.alias("w"), (F.col("hung") + goes_on.cast("long")).alias("n_children")))
    own = local.groupBy(F.col("owner").alias("id")).agg(F.sum("w").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    sums = chain_sums(cut(own.join(hung.select("id", "parent"), "id", "left")))

    gathered = sums.where("parent is not null").join(hung.select("id", "at"), "id").groupBy(F.col("parent").alias("owner"), F.col("at").alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    starts = hung.select(F.col("id").alias("owner"), (F.col("at") + 1).alias("depth"), F.col("parent"))
    ends = owned.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("above")).alias("owner"), F.col("length").alias("depth"), "conv_id").unionByName(spark.createDataFrame([(top, root["m"]["length"], top)], "owner long, depth long, conv_id long"))
    full = local.join(gathered, key, "left").join(starts, key, "left").join(end_digests(ends), key, "left")
    full = full.select(
        *key, "n_convs", "n_children", F.floor(F.col("depth") / BLOCK).alias("block"),
        (F.col("w") + F.coalesce("s", F.lit(0))).alias("s"), ((F.col("n_children") == 0).cast("long") + F.coalesce("l", F.lit(0))).alias("l"),
        F.when((F.col("owner") == top) & (F.col("depth") == 0), None).otherwise(F.coalesce("parent", "owner")).alias("parent_conv_id"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    full = cut(full)
    deeper = Window.partitionBy("owner", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy("owner").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = full.groupBy("owner", "block").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    tails = blocks.select("owner", "block", F.sum("s").over(beyond).alias("more_s"), F.sum("l").over(beyond).alias("more_l")).where("more_s is not null or more_l is not null")
    run = full.withColumn("s", F.sum("s").over(deeper)).withColumn("l", F.sum("l").over(deeper))
    out = run.join(tails, ["owner", "block"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("l") + F.coalesce("more_l", F.lit(0))).alias("n_leaves"), (F.col("s") + F.coalesce("more_s", F.lit(0))).alias("saved_tokens"), "ends_sha256",
    )
