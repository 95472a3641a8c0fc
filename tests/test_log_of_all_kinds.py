"""The log of all kinds: every kind's answer is among its columns, constraints count, and landmarks serve estimates after updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import graph, landmarks, search
from wayloom.plans import events as plan
from wayloom.plans import roads

LINE = 6


def _tables(spark):
    """The line 0-1-...-5 of two-way edges of 10 m, an edge 0-5 of 60 m, and an update of each at seq 4."""
    nodes = spark.createDataFrame([(i, 19.0 + i / 1000, 72.0, ["atm"] if i in (2, 5) else []) for i in range(LINE)], "id long, lat double, lon double, pois array<string>")
    rows = [(i, i, i + 1, 10.0, False, "local", 1.0, [10.0] * 96, True) for i in range(LINE - 1)] + [(9, 0, 5, 60.0, False, "expressway", 1.0, [10.0] * 96, True)]
    edges = spark.createDataFrame(rows, "id long, u long, v long, length double, oneway boolean, road_type string, avg_time double, speed_profile array<double>, active boolean")

    class Given(dict):
        stored = dict.__getitem__

        def pois(self):
            return nodes

        def profiled(self):
            return edges

    asked = [(s, s, 0, 5, "distance", t, n) for s, t, n in ((1, None, None), (2, None, 3), (3, "local", None), (7, "expressway", 3))]
    return Given(
        path_requests=spark.createDataFrame(asked, "id long, seq long, source long, target long, mode string, forbidden_road_type string, forbidden_node long"),
        kpath_requests=spark.createDataFrame([(6, 0, 2, 2, 50.0)], "id long, source long, target long, k int, overlap_threshold double"),
        approx_requests=spark.createDataFrame([(6, 0, 4, 30.0)], "pair_id long, source long, target long, acceptable_error_pct double"),
        fleet_orders=spark.createDataFrame([(6, 1, 1, 0, 1, 3)], "id long, order_id int, num_drivers int, depot_node long, pickup long, dropoff long"),
        knn_requests=spark.createDataFrame([(8, 8, "atm", 19.0, 72.0, 2, m) for m in ("euclidean",)] + [(9, 9, "atm", 19.0, 72.0, 2, "shortest_path")], "id long, seq long, poi string, lat double, lon double, k int, metric string"),
        updates=spark.createDataFrame([(4, 4, "modify_edge", 9, 55.0, None)], "seq long, id long, type string, edge_id long, p_length double, p_road_type string"),
    )


def test_every_kind_of_the_log_has_its_answer(spark, monkeypatch):
    given = _tables(spark)
    monkeypatch.setattr(roads, "Tables", lambda spark, sf_dir: given)
    got = {r["seq"]: r.asDict() for r in roads.QUERIES["mixed_log_all_kinds"](spark, "").collect()}
    assert [(got[10 * s]["minimum"], got[10 * s]["path"]) for s in (1, 2, 3)] == [(50.0, "0,1,2,3,4,5"), (60.0, "0,5"), (60.0, "0,5")]
    assert got[70]["possible"] is False and got[70]["path"] is None
    assert got[80]["result"] == "2,5" == got[90]["result"]
    assert got[64]["assignments"] is not None and got[64]["total_delivery_time_s"] is not None and got[64]["total_delivery_time_s"] > 0
    assert got[61]["paths"].startswith('[{"path":[0,1,2]') and got[62]["paths"] and got[63]["distances"] and got[40]["done"]


def test_landmarks_bound_distances_at_every_place_of_a_log(spark, monkeypatch):
    given, searched = _tables(spark), []
    plain = search.distances

    def counted(nodes, adj, searches, **more):
        searched.append(searches.count())
        return plain(nodes, adj, searches, **more)

    monkeypatch.setattr(search, "distances", counted)
    schema = "seq long, id long, type string, queries array<struct<source:long,target:long>>, acceptable_error_pct double, orders array<struct<order_id:long,pickup:long,dropoff:long>>, fleet struct<depot_node:long>, edge_id long, patch struct<length:double,average_time:double,speed_profile:array<double>,road_type:string>"
    ask = lambda seq: (seq, seq, "approx_shortest_path", [(a, b) for a in range(LINE) for b in range(LINE)], 40.0, None, None, None, None)
    change = lambda seq, kind, edge, length: (seq, seq, kind, None, None, None, None, edge, length and (length, None, None, None))
    log = [ask(1), change(2, "modify_edge", 9, 70.0), ask(3), change(4, "modify_edge", 1, 12.0), ask(5), change(6, "remove_edge", 3, None), ask(7)]
    got = {r["seq"]: {(d["source"], d["target"]): d["approx_shortest_distance"] for d in r["distances"]} for r in plan.answer_events(given.pois(), given.profiled(), spark.createDataFrame(log, schema)).collect() if r["distances"]}
    lines = {1: ([10, 10, 10, 10, 10], 60), 3: ([10, 10, 10, 10, 10], 70), 5: ([10, 12, 10, 10, 10], 70), 7: ([10, 12, 10, 1e9, 10], 70)}
    for seq, (steps, round_) in lines.items():
        for a in range(LINE):
            for b in range(LINE):
                along = sum(steps[min(a, b) : max(a, b)])
                exact = min(along, round_ + sum(steps) - along)
                assert exact <= got[seq][a, b] <= 1.4 * exact, (seq, a, b)
    # before, all 3 * 36 pairs after the first update were searched
    assert searched[0] < 90, searched


def test_bounds_of_versions(spark):
    spans = [(1, 0, 1, 10.0, True, -9, 5), (1, 0, 1, 4.0, True, 5, 99), (2, 1, 2, 10.0, True, -9, 5), (2, 1, 2, 10.0, False, 5, 99), (3, 1, 2, 50.0, True, -9, 99)]
    versions = spark.createDataFrame([(i, u, v, w, False, on, a, b) for i, u, v, w, on, a, b in spans], "id long, u long, v long, length double, oneway boolean, active boolean, valid_from long, valid_to long")
    marks = spark.createDataFrame([(0, 0)], "pos int, landmark long")
    tables = graph.cut(landmarks.tables_of_versions(graph.adjacency(versions), versions, marks))
    got = {r["node"]: (r["d_from"], r["u_from"]) for r in tables.collect()}
    assert got == {0: ([0.0], [0.0]), 1: ([4.0], [10.0]), 2: ([14.0], [60.0])}
    pairs = spark.createDataFrame([(1, 0, 2)], "pair_id long, source long, target long")
    assert landmarks.bounds(tables, pairs).select(F.round("lower", 6), F.round("upper", 6)).first() == (14.0, 60.0)
