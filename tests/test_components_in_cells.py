"""Strongly connected components by levels of cells."""

from __future__ import annotations

import random

from wayloom.operators import components, graph


def _brute(n, ways):
    reach = [{i} for i in range(n)]
    grown = True
    while grown:
        grown = False
        for u, v in ways:
            if not reach[v] <= reach[u]:
                reach[u] |= reach[v]
                grown = True
    return {a: min(b for b in reach[a] if a in reach[b]) for a in range(n)}


def _got(spark, n, ways):
    adj = spark.createDataFrame(ways, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    return {r["node"]: r["component_id"] for r in components.strongly_connected_components(adj, nodes).collect()}


def test_random_graphs_in_cells_of_few_nodes(spark, monkeypatch):
    rng = random.Random(5)
    for most, shrink in ((1, 0.2), (4, 0.0), (7, 0.2), (100, 0.2)):
        monkeypatch.setattr(components, "CELL_NODES", most)
        monkeypatch.setattr(components, "SHRINK", shrink)
        ways = [(min(a, b), max(a, b)) if rng.random() < 0.5 else (a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(62))]
        assert _got(spark, 40, ways) == _brute(40, ways)


def test_a_long_road_takes_few_steps(spark, monkeypatch):
    made = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda *a: made.append(1) or cut(*a))
    monkeypatch.setattr(components, "CELL_NODES", 50)
    # two ways for 200 nodes, then one way for 100, at whose end two nodes form a loop
    ways = [w for i in range(200) for w in ((i, i + 1), (i + 1, i))] + [(i, i + 1) for i in range(200, 299)] + [(299, 298)]
    got = _got(spark, 300, ways)
    assert got == {i: 0 if i <= 200 else 298 if i >= 298 else i for i in range(300)}
    assert len(made) < 20
