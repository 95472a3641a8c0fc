"""Searches that end within a region against plain ones, and that they need no rounds."""

from __future__ import annotations

import random

from wayloom.operators import cells, graph, search


def _town(rng, side):
    """Grid ways with ties and lengths of 0, some one-way, of two road types and two spans of a log."""
    out = []
    for i in range(side * side):
        for j in (i + 1 if (i + 1) % side else None, i + side if i + side < side * side else None):
            if j is not None:
                for u, v in [(i, j)] + ([(j, i)] if rng.random() < 0.8 else []):
                    out.append((u, v, rng.choice([0.0, 0.1, 0.2, 0.3, 1.0]), rng.choice(["local", "local", "primary"]), *rng.choice([(0, 20), (0, 20), (5, 20)])))
    return out


def _answers(df):
    return {r["search_id"]: (r["possible"], r["path"], r["cost"]) for r in df.collect()}


def test_searches_closed_in_a_region_answer_as_plain_ones(spark, monkeypatch):
    rng = random.Random(20)
    side = 12
    ways = _town(rng, side)
    adj = spark.createDataFrame(ways, "src long, dst long, length double, road_type string, valid_from long, valid_to long").selectExpr("*", "length + 0.5 as avg_time")
    nodes = spark.createDataFrame([(i, float(i // side), float(i % side)) for i in range(side * side)] + [(999, 0.5, 0.5)], "id long, lat double, lon double")
    rows = []
    for i in range(120):
        u = rng.randrange(side * side)
        v = rng.choice([u, 999, rng.randrange(side * side), *[min(u + d, side * side - 1) for d in (1, 2, side, side + 1, 2 * side)]])
        on = rng.sample([w for w in ways if w[0] == u] + ways, 4)
        rows.append((i, u, v, rng.randrange(24), rng.sample(range(side * side), 5) if i % 3 == 0 else None, ["primary"] if i % 5 == 0 else None, [{"u": w[0], "v": w[1]} for w in on] if i % 2 else None))
    asked = spark.createDataFrame(rows, "search_id long, source long, target long, seq long, forbidden_nodes array<long>, forbidden_road_types array<string>, forbidden_edges array<struct<u:long,v:long>>")
    monkeypatch.setattr(cells, "AROUND", 3)
    shut, real = [], cells.closed

    def closed(*args):
        out = real(*args)
        shut.append(out.count())
        return out

    monkeypatch.setattr(cells, "closed", closed)
    homes = [cells.assign(nodes, n) for n in (9, 40)]
    for mode in ("distance", "avg_time"):
        shut.clear()
        plain = _answers(search.shortest_paths(nodes, adj, asked, mode, where=homes[0], far=False))
        got = _answers(search.shortest_paths(nodes, adj, asked, mode, where=homes[0], homes=homes))
        assert got == plain and sum(r[0] for r in got.values()) > 40
        # some end in regions of small cells, some in those of larger ones, some in rounds
        assert len(shut) == 2 and shut[0] > 20 and shut[1] > 0 and sum(shut) < 120


def test_searches_over_short_ways_need_no_rounds(spark, monkeypatch):
    n = 400
    adj = spark.createDataFrame([(u, v, 1.0) for i in range(n - 1) for u, v in ((i, i + 1), (i + 1, i))], "src long, dst long, length double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    monkeypatch.setattr(cells, "HOME_NODES", (16, 64))
    asked = spark.createDataFrame([(i, i * 9, i * 9 + 7) for i in range(40)], "search_id long, source long, target long")
    monkeypatch.setattr(cells, "rounds", None)
    got = _answers(search.shortest_paths(nodes, adj, asked))
    assert got == {i: (True, list(range(i * 9, i * 9 + 8)), 7.0) for i in range(40)}


def test_profiles_of_a_log_are_numbers_of_lists_met_once(spark):
    edges = spark.createDataFrame([(i, [1.0, 2.0] if i % 2 else [3.0]) for i in range(6)] + [(6, None)], "id long, speed_profile array<double>")
    changes = spark.createDataFrame([(0, [3.0]), (1, None), (2, [])], "edge_id long, p_speed_profile array<double>")
    told, patched, lists = graph.profile_ids(edges, changes)
    known = {r["profile"]: r["speed_profile"] for r in lists.collect()}
    assert len(known) == 3 and dict(told.dtypes)["speed_profile"] == dict(patched.dtypes)["p_speed_profile"] == "bigint"
    assert {r["id"]: known.get(r["speed_profile"]) for r in told.collect()} == {i: [1.0, 2.0] if i % 2 else [3.0] for i in range(6)} | {6: None}
    assert {r["edge_id"]: known.get(r["p_speed_profile"]) for r in patched.collect()} == {0: [3.0], 1: None, 2: []}
