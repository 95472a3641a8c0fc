"""Reachability and strongly connected components: cells are contracted, then what is left of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells, graph

#: Nodes that one task contracts at most.
CELL_NODES = 32_768

#: Share of its nodes a level must settle or contract; else colours spread in rounds.
SHRINK = 0.2


def _spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the largest label among a node's own and those that reach it over ``edges`` (src, dst)."""
    done = graph.cut(seeds.select("node", "label", F.lit(True).alias("new")))
    while True:
        told = done.filter("new").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label", F.lit(True).alias("new"))
        both = done.withColumn("new", F.lit(False)).unionByName(told)
        # of equal labels the older one wins, so that only real gains count as new
        best = both.groupBy("node").agg(F.max(F.struct("label", (~F.col("new")).alias("old"))).alias("b"))
        done = graph.cut(best.select("node", "b.label", (~F.col("b.old")).alias("new")), done)
        if done.filter("new").isEmpty():
            return done.select("node", "label")


def _trim(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take off nodes without an edge in or out; returns them, the other nodes and their edges."""
    single = None
    while True:
        inner = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        off = graph.cut(nodes.join(inner, "node", "left_anti"))
        if off.isEmpty():
            return (off if single is None else single), nodes, edges
        single = off if single is None else graph.cut(single.unionByName(off))
        nodes = graph.cut(nodes.join(off, "node", "left_anti"))
        kept = nodes.select("node")
        edges = graph.cut(edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi"))


def _local(out: list[list[int]]) -> list[int]:
    """The component of each place of a graph given as lists of successors, by one walk in depth."""
    found, low, part, stack = [-1] * len(out), [0] * len(out), [-1] * len(out), []
    clock = 0
    for start in range(len(out)):
        if found[start] >= 0:
            continue
        walk = [(start, iter(out[start]))]
        found[start] = low[start] = clock
        clock += 1
        stack.append(start)
        while walk:
            at, more = walk[-1]
            for to in more:
                if found[to] < 0:
                    found[to] = low[to] = clock
                    clock += 1
                    stack.append(to)
                    walk.append((to, iter(out[to])))
                    break
                if part[to] < 0:
                    low[at] = min(low[at], found[to])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[at])
                if low[at] == found[at]:
                    while True:
                        one = stack.pop()
                        part[one] = at
                        if one == at:
                            break
    return part


def _closed(part: list[int], inner: list[tuple[int, int]], entered: set[int], left: set[int]) -> set[int]:
    """The components that no cycle leaves: taken off while nothing else enters them, or they enter nothing else.

    ``inner``: steps inside the cell; ``entered`` and ``left``: components with steps from and to other cells.
    """
    steps = {(part[a], part[b]) for a, b in inner if part[a] != part[b]}
    gone: set[int] = set()
    for outside, ways in ((entered, steps), (left, {(b, a) for a, b in steps})):
        n, after = dict.fromkeys(set(part), 0), {}
        for a, b in ways:
            if a not in gone and b not in gone:
                n[b] += 1
                after.setdefault(a, []).append(b)
        ready = [c for c, k in n.items() if not k and c not in outside and c not in gone]
        while ready:
            one = ready.pop()
            gone.add(one)
            for b in after.get(one, ()):
                n[b] -= 1
                if not n[b] and b not in outside:
                    ready.append(b)
    return gone


def _contract(own: pa.Table, steps: pa.Table) -> pa.Table:
    """node, root (the smallest node of its component inside the cell) and whole (no cycle leaves that component)."""
    nodes = sorted(own.column("node").to_pylist())
    at = {node: k for k, node in enumerate(nodes)}
    out: list[list[int]] = [[] for _ in nodes]
    inner, ins, outs = [], [], []
    for src, dst in zip(steps.column("src").to_pylist(), steps.column("dst").to_pylist()):
        a, b = at.get(src), at.get(dst)
        if a is None:
            ins.append(b)
        elif b is None:
            outs.append(a)
        else:
            out[a].append(b)
            inner.append((a, b))
    part = _local(out)
    least: dict[int, int] = {}
    for node, p in zip(nodes, part):
        least.setdefault(p, node)
    gone = _closed(part, inner, {part[b] for b in ins}, {part[a] for a in outs})
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([least[p] for p in part], pa.int64()), "whole": pa.array([p in gone for p in part], pa.bool_())})


def strongly_connected_components(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component_id: the smallest node of each strongly connected component.

    Level by level: nodes lie in cells of at most ``CELL_NODES`` (``cells.assign``), each task contracts the
    components inside its cell to their smallest node and takes off those that no cycle leaves; what is left lies in
    fewer cells at the next level, the last of which is one cell. A graph that hardly shrinks so, as
    its cycles are all long, goes on in rounds of colours (``_coloured``).
    """
    place = [c for c in ("lat", "lon") if {"lat", "lon"} <= set(nodes.columns)]
    left = graph.cut(nodes.select("id", *place).filter("id is not null").dropDuplicates(["id"]))
    edges = adj.select("src", "dst").filter("src <> dst").distinct()
    levels: list[DataFrame] = []
    n = left.count()
    while n:
        one = left.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("cell"))
        where = graph.cut(one) if n <= CELL_NODES else cells.assign(left, CELL_NODES)
        at = lambda end, name: where.select(F.col("node").alias(end), F.col("cell").alias(name))
        met = edges.join(at("src", "a"), "src").join(at("dst", "b"), "dst")
        touched = met.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("cell"), "src", "dst")
        found = where.groupBy("cell").cogroup(touched.groupBy("cell")).applyInArrow(_contract, "node long, root long, whole boolean")
        levels.append(graph.cut(found))
        open_ = levels[-1].filter("not whole")
        left = graph.cut(left.join(open_.filter("node = root").select(F.col("node").alias("id")), "id"))
        before, n = n, left.count()
        if not n:
            break
        root = lambda end: open_.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        kept = edges.join(root("src"), "src").join(root("dst"), "dst").filter("_src <> _dst")
        edges = graph.cut(kept.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
        if n > (1 - SHRINK) * before:
            levels.append(graph.cut(_coloured(edges, left).select("node", F.col("component_id").alias("root"), F.lit(True).alias("whole"))))
            break
    if not levels:
        return left.select(F.col("id").alias("node"), F.col("id").alias("component_id"))
    last = levels[-1].select("node", F.col("root").alias("component_id"))
    for level in reversed(levels[:-1]):
        up = last.select(F.col("node").alias("root"), "component_id")
        last = graph.cut(level.join(up, "root", "left").select("node", F.coalesce("component_id", "root").alias("component_id")))
    return last


def _coloured(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """``strongly_connected_components`` by labels alone.

    Rounds of: trim nodes that cannot lie on a cycle; spread the largest node id
    forward; within the nodes of one colour, those from which its root is reached
    form a component, found by spreading the root backward. Each round takes off
    at least one component of every colour.
    """
    left = graph.cut(nodes.select(F.col("id").alias("node")).distinct())
    edges = graph.cut(adj.select("src", "dst").filter("src <> dst").distinct())
    parts: list[DataFrame] = []
    while not left.isEmpty():
        single, left, edges = _trim(left, edges)
        parts.append(single.select("node", F.col("node").alias("root")))
        if left.isEmpty():
            break
        colour = _spread(left.select("node", F.col("node").alias("label")), edges)
        same = edges.join(colour.select(F.col("node").alias("src"), F.col("label").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("d")), "dst").filter("c = d")
        back = graph.cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = _spread(colour.filter("node = label"), back).select("node", F.col("label").alias("root"))
        parts.append(graph.cut(found))
        left = graph.cut(left.join(found, "node", "left_anti"))
        kept = left.select("node")
        edges = graph.cut(edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    every = parts[0] if parts else left.select("node", F.col("node").alias("root"))
    for p in parts[1:]:
        every = every.unionByName(p)
    least = every.groupBy("root").agg(F.min("node").alias("component_id"))
    return every.join(least, "root").select("node", "component_id")


def component_sizes(components: DataFrame) -> DataFrame:
    """component_id, n_nodes."""
    return components.groupBy("component_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def reachable(adj: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, reachable for ``pairs`` (pair_id, source, target).

    A node reaches itself; an unknown end reaches nothing. Pairs of one strongly
    connected component are settled by a join; for the others, the components
    seen are searched in rounds, each component once per source.
    """
    parts = graph.cut(strongly_connected_components(adj, nodes))
    s, t = (parts.select(F.col("node").alias(n), F.col("component_id").alias(c)) for n, c in (("source", "sc"), ("target", "tc")))
    known = graph.cut(pairs.join(s, "source", "left").join(t, "target", "left").select("pair_id", "sc", "tc"))
    a, b = (parts.select(F.col("node").alias(n), F.col("component_id").alias(c)) for n, c in (("src", "a"), ("dst", "b")))
    over = graph.cut(adj.select("src", "dst").join(a, "src").join(b, "dst").filter("a <> b").select("a", "b").distinct())
    seen = graph.cut(known.filter("sc <> tc").select(F.col("sc").alias("start"), F.col("sc").alias("at")).distinct())
    front = seen
    while not front.isEmpty():
        step = front.join(over, F.col("at") == F.col("a")).select("start", F.col("b").alias("at")).distinct()
        front = graph.cut(step.join(seen, ["start", "at"], "left_anti"))
        seen = graph.cut(seen.unionByName(front))
    hit = seen.select(F.col("start").alias("sc"), F.col("at").alias("tc"), F.lit(True).alias("hit"))
    return known.join(hit, ["sc", "tc"], "left").select("pair_id", F.coalesce(F.col("sc") == F.col("tc"), F.lit(False)).alias("same"), "hit").select("pair_id", (F.col("same") | F.coalesce("hit", F.lit(False))).alias("reachable"))
