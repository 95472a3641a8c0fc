"""Streams of answers and schedules, and searches on graphs of many edges, against their plain forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import fleet, graph, knn, search
from wayloom.plans import events as plan
from wayloom.streaming import streams

from .test_roads import edges, nodes

EVENT = "seq long, id long, type string, edge_id long, patch struct<length:double,average_time:double,speed_profile:array<double>,road_type:string>, source long, target long, mode string"


def _in_batches(spark, frames, folder):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _plain(rows):
    return sorted((r["seq"], r["possible"], r["minimum"], r["path"], r["removed"], r["done"], r["error"]) for r in rows)


def test_answers_of_a_stream_equal_those_of_the_log(spark, tmp_path):
    base = edges(spark, [(0, 1, 5), (1, 2, 5), (0, 3, 9), (3, 2, 9)])
    ask = lambda seq: (seq, seq, "shortest_path", None, None, 0, 2, "distance")
    rows = [ask(1), (2, 2, "remove_edge", 1, None, None, None, None), ask(3), (4, 4, "modify_edge", 2, (1.0, None, None, None), None, None, None), ask(5), (6, 6, "remove_edge", 77, None, None, None, None), (7, 7, "modify_edge", 1, (2.0, None, None, None), None, None, None), ask(8)]
    log = spark.createDataFrame(rows, EVENT)
    want = _plain(plan.answer_events(nodes(spark, 4), base, log).collect())
    assert [w[2] for w in want if w[0] in (1, 3, 5, 8)] == [10.0, 18.0, 10.0, 7.0]
    stream = _in_batches(spark, [log.filter("seq <= 3"), log.filter("seq between 4 and 6"), log.filter("seq > 6")], f"file://{tmp_path}/in")
    got, batches = [], []

    def sink(answers, number):
        batches.append(number)
        got.extend(answers.collect())

    streams.stream_answers(stream, nodes(spark, 4), base, f"file://{tmp_path}/state", sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert _plain(got) == want and batches == [0, 1, 2]
    state = {r["id"]: (r["active"], r["length"]) for r in streams.EdgeState(base, f"file://{tmp_path}/state").edges().collect()}
    assert state == {0: (True, 5.0), 1: (True, 2.0), 2: (True, 1.0), 3: (True, 9.0)}
    assert len([p for p in (tmp_path / "state").iterdir() if p.name[:1] == "v"]) == 2


def test_newer_requests_are_scheduled_again(spark, tmp_path):
    adj = graph.adjacency(edges(spark, [(i, i + 1, 13.8) for i in range(6)]).withColumn("avg_time", F.lit(0.0)))
    order = "seq long, id long, orders array<struct<order_id:long,pickup:long,dropoff:long>>, num_drivers int, depot_node long"
    rows = [(1, 1, [(10, 1, 2)], 1, 0), (2, 2, [(20, 4, 3)], 1, 5), (3, 1, [(10, 1, 2), (11, 3, 6)], 1, 0), (4, 2, [], 2, 5), (5, 2, [(21, 5, 6)], 1, 5)]
    asked = spark.createDataFrame(rows, order)
    stream = _in_batches(spark, [asked.filter("seq <= 2"), asked.filter("seq > 2")], f"file://{tmp_path}/in")
    told = {}

    def sink(planned, number):
        told[number] = {r["id"]: (r["assignments"], round(r["total_delivery_time_s"], 6)) for r in planned.collect()}

    streams.stream_schedules(stream, nodes(spark, 7), adj, sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    for number, seqs in ((0, (1, 2)), (1, (3, 5))):
        own = asked.filter(F.col("seq").isin(*seqs))
        want = {r["id"]: (r["assignments"], round(r["total_delivery_time_s"], 6)) for r in fleet.schedule_deliveries(nodes(spark, 7), adj, own.drop("seq")).collect()}
        assert told[number] == want
    assert [a["route"] for a in told[1][1][0]] == [[0, 1, 2, 3, 4, 5, 6]] and [a["order_ids"] for a in told[1][2][0]] == [[21]]


@pytest.mark.parametrize("merge", [2, 16])
def test_many_edges_give_the_labels_of_few(spark, monkeypatch, merge):
    monkeypatch.setattr(search, "MERGE", merge)
    rng = random.Random(11)
    rows = [(i, i + 1, rng.randint(1, 9)) for i in range(13)] + [(rng.randrange(14), rng.randrange(14), rng.randint(1, 30), "local", rng.random() < 0.5) for _ in range(12)]
    adj = graph.cut(graph.adjacency(edges(spark, rows)))
    one = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate([(0, 13), (13, 0), (5, 5), (3, 9), (2, 40)])], "search_id long, source long, target long")
    plain = {(r["search_id"], r["node"]): (r["cost"], r["path"]) for r in search.labels(adj, one, with_path=True).collect()}
    many = {(r["search_id"], r["node"]): (r["cost"], r["path"]) for r in search.labels(adj, one, with_path=True, few=0).collect()}
    for k, s, t in one.collect():
        assert many.get((k, t)) == plain.get((k, t))
    whole = lambda few: {(r["search_id"], r["node"], r["cost"]) for r in search.labels(adj, one.drop("target"), few=few).collect()}
    assert whole(0) == whole(None)


def test_many_edges_and_places(spark, monkeypatch):
    places = nodes(spark, 7, {1: ["atm"], 3: ["atm"], 4: ["atm"], 6: ["atm"]})
    adj = graph.adjacency(edges(spark, [(0, 1, 10), (1, 2, 10), (2, 3, 10), (0, 4, 25), (5, 6, 1)]))
    points = spark.createDataFrame([(1, "atm", 19.0, 72.0, 2), (2, "atm", 19.0, 72.0, 9), (4, "zoo", 19.0, 72.0, 2)], "id long, poi string, lat double, lon double, k int")
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    got = [(r["id"], r["node"], r["dist"]) for r in knn.poi_knn(places, adj, points, "shortest_path").orderBy("id", "rank").collect()]
    assert got == [(1, 1, 10.0), (1, 4, 25.0), (2, 1, 10.0), (2, 4, 25.0), (2, 3, 30.0)]
