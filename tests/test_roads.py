"""Road operators on hand-made graphs, with answers worked out by hand or by brute force."""

from __future__ import annotations

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions import geo, paths
from wayloom.operators import components, fleet, graph, ingest, knn, kpaths, landmarks, search, updates
from wayloom.plans import events as plan
from wayloom.plans import roads
from wayloom.sources import files
from wayloom.streaming import streams

EDGE = "id long, u long, v long, length double, road_type string, oneway boolean, avg_time double, speed_profile array<double>, active boolean"


def edges(spark, rows):
    """(u, v, length[, type, oneway, profile]) to an edge table."""
    full = []
    for i, r in enumerate(rows):
        u, v, length, kind, oneway, profile = (*r, *("local", False, None)[len(r) - 3 :])
        full.append((i, u, v, float(length), kind, oneway, float(length) / 10, profile or [10.0] * 96, True))
    return spark.createDataFrame(full, EDGE)


def nodes(spark, n, poi=None):
    rows = [(i, 19.0 + 0.001 * (i // 5), 72.0 + 0.001 * (i % 5), (poi or {}).get(i, [])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, lat double, lon double, pois array<string>")


def ask(spark, rows, columns="search_id long, source long, target long, forbidden_nodes array<long>, forbidden_road_types array<string>, forbidden_edges array<struct<u:long,v:long>>"):
    return spark.createDataFrame(rows, columns)


def answers(df, key="search_id"):
    return {r[key]: r for r in df.collect()}


DIAMOND = [(0, 1, 5), (1, 3, 5), (0, 2, 5, "primary"), (2, 3, 5), (3, 4, 1, "local", True), (0, 1, 9, "primary")]


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_constrained_paths(spark, monkeypatch, broadcast):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", broadcast)
    adj = graph.adjacency(edges(spark, DIAMOND))
    none = (None, None, None)
    rows = [(1, 0, 4, *none), (2, 4, 0, *none), (3, 2, 2, *none), (4, 0, 3, [1], None, None), (5, 0, 1, None, ["local"], None), (6, 0, 3, None, None, [(0, 1)]), (7, 0, 99, *none), (8, 0, 3, [0], None, None), (9, 0, 3, [3], None, None), (10, 0, 4, *none)]
    got = answers(search.shortest_paths(nodes(spark, 6), adj, ask(spark, rows)))
    assert (got[1]["cost"], got[1]["path"]) == (11.0, [0, 1, 3, 4]) and got[10]["path"] == got[1]["path"]
    assert not got[2]["possible"] and got[2]["cost"] is None and got[2]["path"] is None
    assert (got[3]["cost"], got[3]["path"]) == (0.0, [2])
    assert got[4]["path"] == [0, 2, 3] and got[6]["path"] == [0, 2, 3]
    assert (got[5]["cost"], got[5]["path"]) == (9.0, [0, 1])
    assert not got[7]["possible"] and not got[8]["possible"] and not got[9]["possible"]


def _drive(t, length, profile):
    while True:
        k = min(int(t // 15), len(profile) - 1)
        v = max(profile[k], 0.0001)
        left = (k + 1) * 15 - t if k < len(profile) - 1 else math.inf
        if v * left >= length:
            return t + length / v
        length -= v * left
        t = (k + 1) * 15


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_changing_speeds(spark, monkeypatch, broadcast):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", broadcast)
    slow = [10.0, 1.0] + [20.0] * 94
    graph_rows = [(0, 1, 200, "local", False, slow), (1, 2, 100, "local", False, [0.0] + [5.0] * 95), (0, 2, 400, "local", True, [10.0] * 96)]
    got = answers(search.shortest_paths(nodes(spark, 3), graph.adjacency(edges(spark, graph_rows)), ask(spark, [(1, 0, 2, None, None, None), (2, 0, 1, None, None, None)]), "time"))
    one = _drive(0, 200, slow)
    assert math.isclose(got[2]["cost"], one) and math.isclose(got[1]["cost"], min(_drive(one, 100, [0.0] + [5.0] * 95), 40.0))


def test_arrival_time_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.random() * 2500, rng.random() * 9000, [rng.choice([0.0, 3.0, 8.0, 20.0]) for _ in range(rng.choice([1, 5, 96]))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "t double, length double, p array<double>").withColumn("v", geo.profile_speeds(F.col("p"))).withColumn("c", geo.profile_cumsum(F.col("v")))
    for r in df.select("*", geo.arrival_time(F.col("t"), F.col("length"), F.col("v"), F.col("c")).alias("a")).collect():
        assert math.isclose(r["a"], _drive(r["t"], r["length"], r["p"]), rel_tol=1e-7)


def _brute_paths(rows, s, t):
    best = {}
    for u, v, w, *rest in rows:
        oneway = len(rest) > 1 and rest[1]
        for a, b in [(u, v)] + ([] if oneway else [(v, u)]):
            best[a, b] = min(best.get((a, b), math.inf), w)
    out, stack = [], [[s]]
    while stack:
        p = stack.pop()
        if p[-1] == t:
            out.append((sum(best[x] for x in zip(p, p[1:])), p))
            continue
        stack += [p + [b] for a, b in best if a == p[-1] and b not in p]
    return sorted(out)


def test_k_shortest_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(a, b, rng.randint(1, 6), "local", rng.random() < 0.3) for a, b in itertools.permutations(range(6), 2) if rng.random() < 0.6]
    df = spark.createDataFrame([(1, 0, 5, 6), (2, 3, 1, 4), (3, 2, 2, 3), (4, 0, 77, 2), (5, 0, 5, 0)], "id long, source long, target long, k int")
    got = {}
    for r in kpaths.k_shortest_paths(nodes(spark, 6), graph.adjacency(edges(spark, rows)), df).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["length"], r["path"]))
    assert got[1] == _brute_paths(rows, 0, 5)[:6] and got[2] == _brute_paths(rows, 3, 1)[:4]
    assert got[3] == [(0.0, [2])] and 4 not in got and 5 not in got


def test_k_diverse(spark):
    ring = [(i, (i + 1) % 6, 1) for i in range(6)]
    df = spark.createDataFrame([(1, 0, 2, 3, 50.0)], "id long, source long, target long, k int, overlap_threshold double")
    got = [r["path"] for r in kpaths.k_diverse_paths(nodes(spark, 6), graph.adjacency(edges(spark, ring)), df).orderBy("rank").collect()]
    assert got == [[0, 1, 2], [0, 5, 4, 3, 2]]


def test_path_functions(spark):
    df = spark.createDataFrame([([1, 2, 3], [3, 4], 12.0, 10.0)], "a array<long>, b array<long>, w double, best double")
    one = df.select(
        paths.path_overlap(F.col("a"), F.col("b")).alias("o"), paths.path_overlap(F.col("a"), F.array().cast("array<long>")).alias("z"),
        paths.path_penalty(F.col("a"), F.col("w"), F.col("best"), F.array("a", "b"), F.lit(0.4)).alias("p"),
        paths.alt_lower_bound(F.array(F.lit(9.0), F.lit(None)), F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(None)), F.array(F.lit(5.0), F.lit(5.0))).alias("l"),
        paths.concat_route(F.lit(1), F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)), F.array(F.lit(2), F.lit(5)))).alias("r"),
    ).first()
    assert one["o"] == 0.5 and one["z"] == 0 and math.isclose(one["p"], 3 * 0.3) and one["l"] == 7.0 and one["r"] == [1, 2, 5]


def test_components_and_reach(spark):
    rows = [(0, 1, 1, "local", True), (1, 2, 1, "local", True), (2, 0, 1, "local", True), (3, 0, 1, "local", True), (4, 5, 1), (2, 4, 1, "local", True)]
    adj = graph.adjacency(edges(spark, rows))
    got = {r["node"]: r["component_id"] for r in components.strongly_connected_components(adj, nodes(spark, 7)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    pairs = spark.createDataFrame([(1, 3, 5), (2, 5, 3), (3, 6, 6), (4, 0, 2), (5, 99, 99), (6, 6, 0)], "pair_id long, source long, target long")
    reach = {r["pair_id"]: r["reachable"] for r in components.reachable(adj, nodes(spark, 7), pairs).collect()}
    assert reach == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_landmarks_and_estimates(spark):
    rng = random.Random(1)
    rows = [(i, i + 1, rng.randint(1, 9)) for i in range(11)] + [(0, 6, 7), (3, 9, 4, "local", True), (12, 13, 1)]
    adj, places = graph.cut(graph.adjacency(edges(spark, rows))), nodes(spark, 14)
    marks = landmarks.select_landmarks(adj, 4)
    assert marks.count() == 4
    tables = landmarks.landmark_distances(adj, marks)
    pairs = spark.createDataFrame([(k, s, t, 10.0) for k, (s, t) in enumerate(itertools.product(range(0, 14, 2), (1, 7, 13, 40)))], "pair_id long, source long, target long, acceptable_error_pct double")
    exact = answers(search.shortest_paths(places, adj, pairs.withColumnRenamed("pair_id", "search_id")))
    for r in landmarks.approx_distances(adj, places, tables, pairs).collect():
        cost = exact[r["pair_id"]]["cost"]
        assert r["distance"] == -1 if cost is None else cost - 1e-9 <= r["distance"] <= cost * 1.1 + 1e-9


def test_nearest(spark):
    rng = random.Random(3)
    places = [(i, 19 + rng.random(), 72 + rng.random(), rng.choice([[], ["atm"], ["atm", "hotel"]])) for i in range(200)]
    df = spark.createDataFrame(places, "id long, lat double, lon double, pois array<string>")
    asked = [(k, "hotel", 18.5 + rng.random() * 2, 72 + rng.random(), rng.randint(0, 7)) for k in range(20)] + [(99, "zoo", 19.0, 72.0, 3), (98, "atm", 60.0, -10.0, 250)]
    points = spark.createDataFrame(asked, "id long, poi string, lat double, lon double, k int")
    got = {}
    for r in knn.poi_knn(df, None, points).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["node"])
    for k, poi, lat, lon, n in asked:
        want = sorted(((a - lat) ** 2 + (b - lon) ** 2, i) for i, a, b, p in places if poi in p)[:n]
        assert got.get(k, []) == [i for _, i in want]


def test_nearest_by_road(spark):
    rows = [(0, 1, 10), (1, 2, 10), (2, 3, 10), (0, 4, 25), (5, 6, 1)]
    places = nodes(spark, 7, {1: ["atm"], 3: ["atm"], 4: ["atm"], 6: ["atm"]})
    points = spark.createDataFrame([(1, "atm", 19.0, 72.0, 2), (2, "atm", 19.0, 72.0, 9), (3, "atm", 19.001, 72.0001, 2), (4, "zoo", 19.0, 72.0, 2)], "id long, poi string, lat double, lon double, k int")
    got = {}
    for r in knn.poi_knn(places, graph.adjacency(edges(spark, rows)), points, "shortest_path").orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["node"], r["dist"]))
    assert got == {1: [(1, 10.0), (4, 25.0)], 2: [(1, 10.0), (4, 25.0), (3, 30.0)], 3: [(6, 1.0)]}


UPDATE = "seq long, id long, type string, edge_id long, p_length double, p_road_type string"
LOG = [(1, 1, "remove_edge", 0, None, None), (2, 2, "remove_edge", 0, None, None), (4, 4, "modify_edge", 0, None, None), (6, 6, "modify_edge", 0, 50.0, None), (7, 7, "modify_edge", 1, None, None), (8, 8, "remove_edge", 77, None, None), (9, 9, "modify_edge", 77, 1.0, None)]


def test_update_log(spark):
    base, log = edges(spark, [(0, 1, 5), (1, 2, 5)]), spark.createDataFrame(LOG, UPDATE)
    got = answers(updates.update_answers(base, log), "seq")
    assert [got[s]["removed"] for s in (1, 2, 8)] == [True, False, False] and got[8]["error"] == "edge not found"
    assert [got[s]["done"] for s in (4, 6, 7, 9)] == [True, True, False, False]
    versions = updates.edge_versions(base, log)
    state = lambda s: {r["id"]: (r["active"], r["length"]) for r in updates.edges_as_of(versions, s).collect()}
    assert state(0)[0] == (True, 5.0) and state(3)[0] == (False, 5.0) and state(5)[0] == (True, 5.0) and state(100)[0] == (True, 50.0)
    asked = spark.createDataFrame([(s, 0, 2, s) for s in (0, 3, 5, 9)], "search_id long, source long, target long, seq long")
    cost = {k: r["cost"] for k, r in answers(search.shortest_paths(nodes(spark, 3), graph.adjacency(versions), asked)).items()}
    assert cost == {0: 10.0, 3: None, 5: 10.0, 9: 55.0}


def test_streamed_updates_are_folded_once(spark, tmp_path):
    base, log = edges(spark, [(0, 1, 5), (1, 2, 5)]), spark.createDataFrame(LOG, UPDATE)
    state = streams.EdgeState(base, f"file://{tmp_path}/state")
    for part in ("seq <= 2", "seq between 3 and 6", "seq <= 6", "seq > 6"):
        state.fold(log.filter(part))
    want = {(r["id"], r["active"], r["length"]) for r in updates.apply_updates(base, log).collect()}
    assert {(r["id"], r["active"], r["length"]) for r in state.edges().collect()} == want
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/in")
    streams.stream_edge_state(stream, base, f"file://{tmp_path}/two").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {(r["id"], r["active"], r["length"]) for r in streams.EdgeState(base, f"file://{tmp_path}/two").edges().collect()} == want


def test_deliveries(spark):
    line = [(i, i + 1, 13.8) for i in range(6)] + [(8, 9, 1)]
    e = edges(spark, line).withColumn("avg_time", F.lit(0.0))
    order = "id long, orders array<struct<order_id:long,pickup:long,dropoff:long>>, num_drivers int, depot_node long"
    asked = spark.createDataFrame([(1, [(10, 1, 2), (11, 2, 4), (12, 0, 6)], 2, 0), (2, [(20, 8, 9)], 1, 0), (3, [], 2, 3)], order)
    got = answers(fleet.schedule_deliveries(nodes(spark, 10), graph.adjacency(e), asked), "id")
    one = {a["driver_id"]: a for a in got[1]["assignments"]}
    assert math.isclose(got[1]["total_delivery_time_s"], 6.0) and sorted(sum((a["order_ids"] for a in one.values()), [])) == [10, 11, 12]
    assert one[1]["route"] == [0] and one[0]["route"] == [0, 1, 2, 3, 4, 5, 6]
    assert [a["order_ids"] for a in got[2]["assignments"]] == [[]] and got[2]["total_delivery_time_s"] == 0
    assert [a["route"] for a in got[3]["assignments"]] == [[3], [3]]


def test_files_and_mixed_log(spark, tmp_path):
    doc = {"meta": {"id": "g"}, "nodes": [{"id": i, "lat": 19 + i / 1000, "lon": 72.0, "pois": [" ", "atm", "atm"] if i == 2 else []} for i in range(4)], "edges": [{"id": i, "u": i, "v": i + 1, "length": 10.0, "average_time": 1.0, "road_type": "local", "oneway": False} for i in range(3)]}
    log = [
        {"id": 1, "type": "shortest_path", "source": 0, "target": 3, "mode": "distance"}, {"id": 2, "type": "remove_edge", "edge_id": 1},
        {"id": 3, "type": "shortest_path", "source": 0, "target": 3, "mode": "time"}, {"id": 4, "type": "modify_edge", "edge_id": 1, "patch": {"length": 20.0}},
        {"id": 5, "type": "shortest_path", "source": 0, "target": 3, "mode": "distance", "constraints": {"forbidden_nodes": [9]}}, {"id": 6, "type": "knn", "poi": "atm", "query_point": {"lat": 19.0, "lon": 72.0}, "k": 2, "metric": "shortest_path"},
        {"id": 7, "type": "k_shortest_paths", "source": 0, "target": 3, "k": 2, "mode": "distance"}, {"id": 8, "type": "approx_shortest_path", "queries": [{"source": 0, "target": 3}, {"source": 0, "target": 44}], "time_budget_ms": 5, "acceptable_error_pct": 5},
        {"id": 9, "type": "what"}, {"id": 10, "type": "knn", "poi": "atm"}, {"id": 11}, {"id": 12, "type": "delivery_scheduling", "orders": [{"order_id": 1, "pickup": 1, "dropoff": 2}], "fleet": {"num_delievery_guys": 1, "depot_node": 0}},
        {"id": 13, "type": "k_shortest_paths_heuristic", "source": 0, "target": 3, "k": 2, "overlap_threshold": 50},
    ]
    (tmp_path / "g.json").write_text(json.dumps(doc))
    (tmp_path / "e.json").write_text(json.dumps({"meta": {"id": "q"}, "events": log}))
    n, e = files.read_graph(spark, f"{tmp_path}/g.json")
    files.write_graph(n, e, f"{tmp_path}/g")
    assert files.read_graph(spark, f"{tmp_path}/g")[1].count() == 3
    out = graph.cut(plan.answer_events(n, e, files.read_events(spark, f"{tmp_path}/e.json"), 2))
    got = answers(out, "id")
    assert got[1]["minimum"] == 30 and not got[3]["possible"] and got[5]["minimum"] == 40 and got[2]["removed"] and got[4]["done"]
    assert got[6]["result"] == [2] and [p["length"] for p in got[7]["paths"]] == [40.0] and [p["path"] for p in got[13]["paths"]] == [[0, 1, 2, 3]]
    assert [d["approx_shortest_distance"] for d in got[8]["distances"]] == [40.0, -1.0]
    assert all(got[i]["status"] == "failed" for i in (9, 10, 11)) and got[11]["error"] == "missing type"
    assert got[12]["assignments"][0]["route"] == [0, 1, 2] and got[12]["metrics"]["total_delivery_time_s"] == 2.0
    files.write_results(out, f"{tmp_path}/lines", "json")
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/lines").orderBy("seq").collect()] == list(range(1, 14))
    files.write_results(out, f"{tmp_path}/doc", "document", "q")
    assert len(spark.read.json(f"{tmp_path}/doc").first()["results"]) == 13


def test_ingest(spark, tmp_path):
    places = [{"type": "node", "id": 10 * i, "lat": 19 + i / 1000, "lon": 72.0} for i in range(6)] + [{"type": "node", "id": 55, "lat": 19.0, "lon": 72.0000001}]
    ways = [{"type": "way", "id": 1, "nodes": [0, 10, 20, 999], "tags": {"highway": "motorway_link"}}, {"type": "way", "id": 2, "nodes": [20, 10], "tags": {"highway": "primary", "oneway": "yes"}}, {"type": "way", "id": 3, "nodes": [30, 40], "tags": {"highway": "steps"}}, {"type": "way", "id": 4, "nodes": [0, 55, 50], "tags": {"highway": "trunk", "oneway": "1"}}]
    (tmp_path / "osm.json").write_text(json.dumps({"elements": places + ways}))
    n, e = ingest.build_graph(*files.read_osm(spark, f"{tmp_path}/osm.json"))
    ids = {r["osm_id"]: r["id"] for r in n.collect()}
    assert sorted(ids) == [0, 10, 20, 50, 55] and sorted(ids.values()) == list(range(5)) and [ids[k] for k in sorted(ids)] == list(range(5))
    back = {v: k for k, v in ids.items()}
    got = {(back[r["u"]], back[r["v"]]): r for r in e.collect()}
    assert set(got) == {(0, 10), (10, 0), (10, 20), (20, 10), (55, 50)}
    assert got[20, 10]["road_type"] == "local" and got[55, 50]["road_type"] == "expressway" and got[55, 50]["oneway"]
    r = got[0, 10]
    assert math.isclose(r["length"], 111.195, abs_tol=0.01) and math.isclose(r["avg_time"], round(r["length"] / 8.33, 3), abs_tol=0.002)
    assert len(r["speed_profile"]) == 96 and all(0.79 * 8.33 <= v <= 1.21 * 8.33 for v in r["speed_profile"])
    assert sorted(x["id"] for x in e.collect()) == list(range(5))


def test_cleaning(spark):
    raw = spark.createDataFrame([(1, 0, 1, None, None), (2, 0, 9, 5.0, 2.0)], "id long, u long, v long, length double, average_time double")
    e = {r["id"]: r for r in graph.fill_speed_profile(graph.normalize_edges(raw), 2).collect()}
    assert (e[1]["length"], e[1]["oneway"], e[1]["road_type"], e[1]["speed_profile"]) == (0.0, True, "", [10.0, 10.0]) and e[2]["speed_profile"] == [2.5, 2.5]
    assert [r["id"] for r in graph.valid_edges(raw, nodes(spark, 3)).collect()] == [1]
    far = geo.distances_to(nodes(spark, 2), spark.createDataFrame([(0,), (9,)], "target long")).collect()
    assert {(r["target"], r["id"]): r["km"] for r in far}[9, 0] == math.inf


def _given(monkeypatch, **tables):
    """Let registered queries run on these tables."""

    class Given(dict):
        stored = dict.__getitem__

    monkeypatch.setattr(roads, "Tables", lambda spark, sf_dir: Given(tables))


def _brute_diverse(rows, s, t, k, theta):
    ids = {(a, b): i for i, (u, v, _, _, oneway) in enumerate(rows) for a, b in [(u, v)] + ([] if oneway else [(v, u)])}
    every = [(w, p, {ids[x] for x in zip(p, p[1:])}) for w, p in _brute_paths(rows, s, t)]
    chosen = every[:1]

    def penalty(paths):
        over = lambda e: sum(len(e & o) / min(len(e), len(o)) > theta for _, _, o in paths)
        return sum((1 + over(e)) * ((w - every[0][0]) / every[0][0] + 0.1) for w, _, e in paths)

    while len(chosen) < k:
        rest = [next((x for x in every if ban not in x[2]), None) for ban in chosen[-1][2]]
        fresh = [x for x in rest if x and x not in chosen]
        if not fresh:
            break
        chosen.append(min(fresh, key=lambda x: (penalty(chosen + [x]), x[1])))
    return sorted((w, p) for w, p, _ in chosen)


def test_k_diverse_query_gives_all_paths_asked_for(spark, monkeypatch):
    rng = random.Random(32)
    rows = [(a, b, rng.uniform(1, 6), "local", rng.random() < 0.2) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.8]
    asked = [(1, 0, 6, 4, 50.0), (2, 1, 5, 5, 30.0), (3, 2, 6, 6, 70.0), (4, 0, 5, 2, 50.0)]
    df = spark.createDataFrame(asked, "id long, source long, target long, k int, overlap_threshold double")
    _given(monkeypatch, nodes=nodes(spark, 7), edges=edges(spark, rows), kpath_requests=df)
    got = {}
    for r in roads.k_diverse(spark, "").orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["length"], [int(x) for x in r["path"].split(",")]))
    for i, s, t, k, theta in asked:
        want = _brute_diverse(rows, s, t, k, theta / 100)
        assert [p for _, p in got[i]] == [p for _, p in want] and all(math.isclose(a, b, abs_tol=1e-6) for (a, _), (b, _) in zip(got[i], want))
    assert max(map(len, got.values())) > 3


def test_components_and_reach_over_all_road_types(spark, monkeypatch):
    rng = random.Random(13)
    kinds = ["expressway", "primary", "secondary", "tertiary", "local"]
    rows = [(rng.randrange(14), rng.randrange(14), 1, kinds[i % 5], rng.random() < 0.8) for i in range(18)]
    pairs = spark.createDataFrame([(100 * a + b, a, b) for a in range(15) for b in range(15)], "pair_id long, source long, target long")
    _given(monkeypatch, nodes=nodes(spark, 14), edges=edges(spark, rows), approx_requests=pairs)
    reach = {(a, a) for a in range(14)} | {(u, v) for u, v, *_ in rows} | {(v, u) for u, v, _, _, oneway in rows if not oneway}
    for c in range(14):
        reach |= {(a, b) for a in range(14) for b in range(14) if (a, c) in reach and (c, b) in reach}
    want = {a: min(b for b in range(14) if (a, b) in reach and (b, a) in reach) for a in range(14)}
    assert {r["node"]: r["component_id"] for r in roads.QUERIES["strong_components_all"](spark, "").collect()} == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert {r["component_id"]: r["n_nodes"] for r in roads.QUERIES["component_sizes_all"](spark, "").collect()} == sizes and max(sizes.values()) > 1
    assert {r["pair_id"]: r["reachable"] for r in roads.QUERIES["reachable_pairs_all"](spark, "").collect()} == {100 * a + b: (a, b) in reach for a in range(15) for b in range(15)}


def test_all_requests_of_a_log_see_the_graph_as_of_their_place(spark):
    """On the line 0-1-2, an update between two rounds of the same requests."""
    nodes = spark.createDataFrame([(i, 19.0 + i / 1000, 72.0, []) for i in range(3)], "id long, lat double, lon double, pois array<string>")
    edges = spark.createDataFrame([(1, 0, 1, 10.0, False), (2, 1, 2, 10.0, False)], "id long, u long, v long, length double, oneway boolean")
    order, fl = [(1, 1, 2)], (0, 1)

    def ask(seq):
        return [
            (seq, seq, "k_shortest_paths", 0, 2, 2, None, None, None, None, None, None, None), (seq + 1, seq + 1, "k_shortest_paths_heuristic", 0, 2, 2, 50.0, None, None, None, None, None, None),
            (seq + 2, seq + 2, "approx_shortest_path", None, None, None, None, [(0, 2)], 5.0, None, None, None, None), (seq + 3, seq + 3, None, None, None, None, None, None, None, order, fl, None, None),
        ]

    log = ask(1) + [(10, 10, "modify_edge", None, None, None, None, None, None, None, None, 2, (30.0, None, None, None))] + ask(11) + [(20, 20, "remove_edge", None, None, None, None, None, None, None, None, 2, None)] + ask(21)
    schema = "seq long, id long, type string, source long, target long, k int, overlap_threshold double, queries array<struct<source:long,target:long>>, acceptable_error_pct double, orders array<struct<order_id:long,pickup:long,dropoff:long>>, fleet struct<depot_node:long,num_drivers:int>, edge_id long, patch struct<length:double,average_time:double,speed_profile:array<double>,road_type:string>"
    got = {r["seq"]: r for r in plan.answer_events(nodes, edges, spark.createDataFrame(log, schema)).collect()}
    for seq, length in ((1, 20.0), (11, 40.0)):
        assert [(list(p["path"]), p["length"]) for p in got[seq]["paths"]] == [([0, 1, 2], length)] == [(list(p["path"]), p["length"]) for p in got[seq + 1]["paths"]]
        assert [d["approx_shortest_distance"] for d in got[seq + 2]["distances"]] == [length]
        assert got[seq + 3]["assignments"][0]["route"] == [0, 1, 2] and abs(got[seq + 3]["metrics"]["total_delivery_time_s"] - length / 13.8) < 1e-9
    assert got[21]["paths"] == [] == got[22]["paths"] and got[23]["distances"][0]["approx_shortest_distance"] == -1.0
    assert got[24]["assignments"][0]["order_ids"] == [] and got[24]["metrics"]["total_delivery_time_s"] == 0.0
    assert got[10]["done"] and got[20]["removed"]


def test_map_data_is_dealt_by_its_steps(spark, monkeypatch):
    monkeypatch.setattr(ingest, "TASK_ROWS", 10)
    places = spark.createDataFrame([(i, 19.0 + i * 0.001, 72.0) for i in range(60)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(i, {"highway": "residential"}, [i, i + 1, i + 2]) for i in range(58)], "id long, tags map<string,string>, nodes array<long>").coalesce(1)
    assert ingest.tasks_of(ways) == 18
    segments = ingest.way_segments(ways, places)
    nodes, edges = ingest.build_graph(places, ways)
    assert sorted((r["id"], r["osm_id"]) for r in nodes.collect()) == [(i, i) for i in range(60)]
    assert sorted((r["id"], r["u"], r["v"]) for r in edges.collect()) == [(n, *e) for n, e in enumerate(sorted({(i, j) for r in segments.collect() for i, j in ((r["u"], r["v"]), (r["v"], r["u"]))}))]
