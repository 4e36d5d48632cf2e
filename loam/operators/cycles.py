"""Strongly connected components, and the elementary cycles within them.

Components by colouring. A node's colour is the greatest label of those that reach it; labels are
hashes, so that they fall anywhere. Each round takes the greatest colour of the nodes before, and
then the colour of the colour: what reaches a node's colour reaches the node. So a colour travels over
stretches that double, and a long acyclic way takes few rounds. Within a colour the same is done
against the edges: a node whose own colour it reaches is in that colour's component. Components
leave, and what is left starts anew; a component lies within one colour, so edges between colours
leave as well. Rounds are joins on tables that shrink; nothing is collected.

A component of up to ``LOCAL_EDGES`` edges is packed into one value, and its cycles are enumerated
from each node in tasks of ``STARTS`` nodes: cycles whose smallest node is the start, on the part of the
larger nodes that lies between the start and itself, with nodes *blocked* that are known not to lead
back until one of their successors is freed. A larger component's cycles grow edge by edge as rows.
There may be exponentially many cycles, but they are only enumerated where there are any.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import cut

LOCAL_EDGES = 20_000
STARTS = 64


def _spread(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``node, color`` with the greatest colour that reaches a node along ``edges(a, b)``."""
    while True:
        before = edges.join(state.select(F.col("node").alias("a"), "color"), "a").groupBy(F.col("b").alias("node")).agg(F.max("color").alias("came"))
        step = state.join(before, "node", "left").select("node", "color", F.greatest("color", "came").alias("new"))
        # what reaches a node's colour reaches the node
        up = step.select(F.col("node").alias("source"), F.col("new").alias("further"))
        jumped = step.join(up, F.col("new.node") == F.col("source"))
        moved = cut(jumped.select("node", F.greatest("new", "further").alias("color"), (F.greatest("new", "further") != F.col("color")).alias("moved")))
        state = moved.select("node", "color")
        if moved.where("moved").isEmpty():
            return state


def _labelled(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return nodes.select("node", F.struct(F.xxhash64("node").alias("h"), "node").alias("color"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges from nodes that no edge leads to, or to nodes that no edge leaves."""
    met = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
    return met.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges(a, b)`` that lie on a cycle of two nodes or more.

    A component is named by one of its nodes. Loops, repeated edges and edges with a null end are
    harmless; without a cycle the result is empty.
    """
    live = cut(_trimmed(edges.where("a <> b").select("a", "b").distinct()))
    out = live.select(F.col("a").alias("node"), F.col("a").alias("component")).where(F.lit(False))
    while not live.isEmpty():
        color = _spread(live, _labelled(live))
        of = lambda end: color.select(F.col("node").alias(end), F.col("color.node").alias(f"{end}_color"))
        same = cut(live.join(of("a"), "a").join(of("b"), "b").where("a_color = b_color").select("a", "b", "a_color"))
        if same.isEmpty():
            break
        back = _spread(same.select(F.col("b").alias("a"), F.col("a").alias("b")), _labelled(same))
        home = same.select(F.col("a").alias("node"), "a_color").union(same.select("b", "a_color")).distinct()
        member = cut(back.join(home, "node").select("node", F.col("a_color").alias("component"), (F.col("color.node") == F.col("a_color")).alias("own")))
        found = member.where("own").select("node", "component")
        alone = found.groupBy("component").count().where("count = 1").select("component")
        out = out.unionByName(found.join(alone, "component", "left_anti").select("node", "component"))
        rest = member.where("not own").select("node")
        live = same.join(rest.withColumnRenamed("node", "a"), "a", "left_semi").join(rest.withColumnRenamed("node", "b"), "b", "left_semi")
        live = cut(_trimmed(live.select("a", "b")))
    return out


def circuits(after: dict[int, list[int]], start: int) -> Iterator[list[int]]:
    """Elementary cycles through ``start`` on nodes that aren't smaller, each as the list of its nodes."""

    def reach(step: dict[int, list[int]]) -> set[int]:
        seen, todo = {start}, [start]
        while todo:
            for x in step.get(todo.pop(), ()):
                if x > start and x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    before: dict[int, list[int]] = {}
    for a, outs in after.items():
        for b in outs:
            before.setdefault(b, []).append(a)
    between = reach(after) & reach(before)
    ways = {a: [b for b in after.get(a, ()) if b in between] for a in between}
    path, blocked = [start], {start}
    waits: dict[int, set[int]] = {}  # blocked nodes by the successor whose release frees them
    stack, closed = [iter(ways[start])], [False]
    while stack:
        for b in stack[-1]:
            if b == start:
                if len(path) > 1:
                    yield list(path)
                closed[-1] = True
            elif b not in blocked:
                path.append(b)
                blocked.add(b)
                stack.append(iter(ways[b]))
                closed.append(False)
                break
        else:
            node, led = path.pop(), closed.pop()
            stack.pop()
            if led:
                todo = [node]
                while todo:
                    x = todo.pop()
                    if x in blocked:
                        blocked.discard(x)
                        todo += waits.pop(x, ())
            else:
                for b in ways[node]:
                    waits.setdefault(b, set()).add(node)
            if closed:
                closed[-1] |= led


def _local(packed: DataFrame, most: int | None) -> DataFrame:
    """Cycles of ``nodes array<string>, outs array<array<int>>, first int``: from the starts ``first`` to ``first + STARTS``."""

    def run(batches):
        for b in batches:
            for nodes, outs, first in zip(*(b.column(i).to_pylist() for i in range(3))):
                after, rows = dict(enumerate(outs)), []
                for s in range(first, min(first + STARTS, len(nodes))):
                    for c in circuits(after, s):
                        if most is None or len(c) <= most:
                            rows.append([nodes[i] for i in c] + [nodes[c[0]]])
                        if len(rows) == 1000:
                            yield pa.record_batch([pa.array(rows, pa.list_(pa.string()))], names=["cycle"])
                            rows = []
                yield pa.record_batch([pa.array(rows, pa.list_(pa.string()))], names=["cycle"])

    return packed.mapInArrow(run, "cycle array<string>")


def _grown(edges: DataFrame, most: int | None) -> DataFrame:
    """Cycles by paths that grow from their smallest node through larger ones, as rows."""
    found, walk = None, edges.where("a < b").select(F.array("a", "b").alias("nodes"), F.col("b").alias("a"))
    for length in count(2):
        step = walk.join(edges, "a")
        closed = cut(step.where(F.col("b") == F.col("nodes")[0]).select(F.concat("nodes", F.array("b")).alias("cycle")))
        found = closed if found is None else found.union(closed)
        if length == most:
            return found
        walk = cut(step.where((F.col("b") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("b"))).select(F.concat("nodes", F.array("b")).alias("nodes"), F.col("b").alias("a")))
        if walk.isEmpty():
            return found


def elementary_cycles(edges: DataFrame, most: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``cycle``: every elementary cycle of ``edges(a, b)`` with two nodes or more, closed, from its smallest node.

    ``most`` bounds the number of nodes, on request. With such a bound, cycles grow as rows wherever
    the bound is small, as a bounded walk is cheaper than all cycles.
    """
    edges = edges.where("a <> b").select("a", "b").distinct()
    of = cut(strong_components(edges))
    inner = edges.join(of.select(F.col("node").alias("a"), "component"), "a").join(of.select(F.col("node").alias("b"), F.col("component").alias("other")), "b")
    inner = cut(inner.where("component = other").select("component", "a", "b"))
    if inner.isEmpty():
        return inner.select(F.array("a").alias("cycle"))
    size = cut(inner.groupBy("component").count())
    small = size.where(F.col("count") <= (local_edges if most is None else 0)).select("component")
    grown = _grown(inner.join(small, "component", "left_anti").select("a", "b"), most)
    # each node's place in its component's order, and its successors' places: a component is bounded by local_edges
    held = inner.join(small, "component", "left_semi")
    nodes = held.groupBy("component").agg(F.array_sort(F.collect_set("a")).alias("nodes"))  # in a component every node has an edge out
    outs = held.join(nodes, "component").groupBy("component", "a", "nodes").agg(F.sort_array(F.collect_list((F.array_position("nodes", F.col("b")) - 1).cast("int"))).alias("o"))
    packed = outs.groupBy("component", "nodes").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "o"))), lambda x: x["o"]).alias("outs"))
    blocks = packed.select("nodes", "outs", F.explode(F.sequence(F.lit(0), F.size("nodes") - 1, F.lit(STARTS))).alias("first"))
    return grown.unionByName(_local(blocks.repartition(F.col("first"), F.col("nodes")[0]), most))
