"""Cells of a graph, and searches over them against all simple paths."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import cells, search


def _smallest(ways, s, t):
    """The smallest (cost, path) over all simple paths."""
    out, best, stack = {}, None, [(0.0, (s,))]
    for u, v, w in ways:
        out.setdefault(u, []).append((v, w))
    while stack:
        cost, path = stack.pop()
        if path[-1] == t:
            best = (cost, path) if best is None or (cost, path) < best else best
            continue
        stack += [(cost + w, (*path, v)) for v, w in out.get(path[-1], ()) if v not in path]
    return best


def test_ties_and_cycles_of_length_zero(spark, monkeypatch):
    monkeypatch.setattr(cells, "UNIT", 7)
    rng, ways, asked, want = random.Random(3), [], [], {}
    for g in range(30):
        order = [g * 100 + i for i in range(8)]
        rng.shuffle(order)
        own = [(order[a], order[b], float(rng.choice([0, 0, 1, 1, 2]))) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.4 or b == a + 1]
        own += [(v, u, w) for u, v, w in own]
        ways += own
        for t in range(1, 8):
            asked.append((g * 10 + t, g * 100, g * 100 + t))
            want[g * 10 + t] = _smallest(own, g * 100, g * 100 + t)
    adj = spark.createDataFrame(ways, "src long, dst long, length double")
    searches = spark.createDataFrame(asked, "search_id long, source long, target long")
    nodes = adj.selectExpr("src as id").distinct()
    for most in (1, 3, 1000):
        where = cells.assign(nodes, most)
        got = {r["search_id"]: (r["cost"], tuple(r["path"])) for r in search.shortest_paths(nodes, adj, searches, where=where).collect()}
        assert got == want


def test_every_place_of_a_border_between_cells(spark):
    # the smaller path ends with a step of length 0 whose nodes lie in other cells
    ways = [(i, i + 1, 1.0) for i in range(6)] + [(6, 9, 5.0), (6, 8, 5.0), (8, 9, 0.0)]
    adj = spark.createDataFrame(ways, "src long, dst long, length double")
    nodes = spark.createDataFrame([(i,) for i in range(10)], "id long")
    one = spark.createDataFrame([(i, i, 9) for i in range(7)], "search_id long, source long, target long")
    for most in (1, 2, 3, 4, 5, 20):
        got = {r["search_id"]: r["path"] for r in search.shortest_paths(nodes, adj, one, where=cells.assign(nodes, most)).collect()}
        assert got == {i: [*range(i, 7), 8, 9] for i in range(7)}


def test_cells_are_bounded_and_hold_every_node_once(spark):
    rng = random.Random(1)
    rows = [(i, 19.0 + rng.random() * 1e-6, 72.0 + rng.random() * 1e-6) for i in range(900)] + [(1000 + i, 20.0 + i, 72.0) for i in range(50)] + [(2000, None, None), (2001, None, None), (5, 19.0, 72.0)]
    nodes = spark.createDataFrame(rows, "id long, lat double, lon double")
    sizes = {r["cell"]: r["count"] for r in cells.assign(nodes, 64).groupBy("cell").count().collect()}
    assert max(sizes.values()) <= 64 and sum(sizes.values()) == 952 and len(sizes) < 60
    assert cells.assign(nodes.limit(0)).count() == 0
    near = {r["node"]: r["cell"] for r in cells.assign(spark.createDataFrame([(8 * x + y, float(x), float(y)) for x in range(8) for y in range(8)], "id long, lat double, lon double").coalesce(1), 16).collect()}
    assert len({near[8 * x + y] for x in range(4) for y in range(4)}) <= 2


def test_arrival_is_that_of_the_expression(spark):
    rng = random.Random(4)
    rows = [(rng.random() * 2500, rng.random() * 9000, [rng.choice([0.0, 3.0, 8.0, 20.0]) for _ in range(rng.choice([1, 5, 96]))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "t double, length double, p array<double>").withColumn("v", geo.profile_speeds(F.col("p"))).withColumn("c", geo.profile_cumsum(F.col("v")))
    for r in df.select("*", geo.arrival_time(F.col("t"), F.col("length"), F.col("v"), F.col("c")).alias("a")).collect():
        assert r["a"] == cells.arrival(r["t"], r["length"], r["v"], r["c"], geo.SLOT_WIDTH)


def test_hot_cell_searches_and_nodes_without_edges(spark, monkeypatch):
    monkeypatch.setattr(cells, "UNIT", 3)
    adj = spark.createDataFrame([(i, (i + 1) % 40, 1.0) for i in range(40)], "src long, dst long, length double")
    nodes = spark.createDataFrame([(i,) for i in range(42)], "id long")
    rows = [(i, 0, i % 42) for i in range(120)]
    got = {r["search_id"]: (r["possible"], r["cost"]) for r in search.shortest_paths(nodes, adj, spark.createDataFrame(rows, "search_id long, source long, target long"), where=cells.assign(nodes, 8)).collect()}
    assert got == {i: (i % 42 < 40, float(i % 42) if i % 42 < 40 else None) for i in range(120)}
    lone = spark.createDataFrame([(1, 41)], "search_id long, source long")
    assert [tuple(r) for r in search.sssp(adj, lone).collect()] == [(1, 41, 0.0)]
    assert search.sssp(adj, lone.limit(0)).count() == 0


def test_costs_are_bounded_by_most(spark):
    adj = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "src long, dst long, length double")
    asked = spark.createDataFrame([(0, 0, 4.0), (1, 3, None), (2, 10, 0.0)], "search_id long, source long, most double")
    where = spark.createDataFrame([(i, i // 3) for i in range(31)], "node long, cell long")
    got = {(r["search_id"], r["node"]): r["cost"] for r in search.labels(adj, asked, where=where).collect()}
    assert got == {(0, i): float(i) for i in range(5)} | {(1, 3 + i): float(i) for i in range(28)} | {(2, 10): 0.0}
    ends = spark.createDataFrame([(0, 0, 7, 7.0), (1, 0, 7, 6.5)], "search_id long, source long, target long, most double")
    assert [(r["search_id"], r["cost"]) for r in search.labels(adj, ends, where=where).collect()] == [(0, 7.0)]
