"""Logs with one hot edge, and streams whose updates arrive out of order."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wayloom.operators import graph, updates
from wayloom.streaming import streams

from .test_roads import UPDATE, edges


def _log(n, hot, seed=5):
    """Updates of which nine of ten are of the edge ``hot``."""
    rng, out = random.Random(seed), []
    for seq in range(n):
        kind = rng.choice(["remove_edge", "modify_edge", "modify_edge"])
        length = float(rng.randint(1, 99)) if kind == "modify_edge" and rng.random() < 0.6 else None
        out.append((seq, seq, kind, hot if rng.random() < 0.9 else rng.randrange(6), length, "primary" if kind == "modify_edge" and rng.random() < 0.2 else None))
    return out


def _state(df):
    return {(r["id"], r["active"], r["length"], r["road_type"]) for r in df.collect()}


def _plain(log, base):
    """All versions by a loop: (id, active, length, type, from)."""
    out, now = [], dict(base)
    for seq, _, kind, edge, length, road in sorted(log):
        if edge in now:
            active, old, was = now[edge]
            now[edge] = (kind != "remove_edge", length if length is not None else old, road or was)
            out.append((edge, *now[edge], seq))
    return out, {(e, *v) for e, v in now.items()}


BASE = [(0, 1, 5), (1, 2, 5), (2, 3, 5), (3, 4, 5)]


def test_runs_of_a_hot_edge_fold_as_one_log(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log, base = _log(400, 1), edges(spark, BASE)
        df = spark.createDataFrame(log, UPDATE)
        runs = df.repartitionByRange("edge_id", "seq").withColumn("run", F.spark_partition_id()).groupBy("run").count().collect()
        assert len(runs) > 2 and max(r["count"] for r in runs) < 3 * sorted(r["count"] for r in runs)[len(runs) // 2]
        want, last = _plain(log, {i: (True, 5.0, "local") for i in range(4)})
        got = [tuple(r) for r in updates.edge_versions(base, df).filter("valid_from >= 0").select("id", "active", "length", "road_type", "valid_from").collect()]
        assert sorted(got, key=lambda r: r[-1]) == want
        follow = {}
        for r in updates.edge_versions(base, df).collect():
            follow.setdefault(r["id"], []).append((r["valid_from"], r["valid_to"]))
        for spans in follow.values():
            spans.sort()
            assert spans[0][0] == updates.FIRST and spans[-1][1] == updates.LAST and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert _state(updates.apply_updates(base, df)) == last
        was = {e: True for e in range(4)}
        for r in sorted(updates.update_answers(base, df).collect(), key=lambda r: r["seq"]):
            if r["type"] == "remove_edge":
                assert r["removed"] == was.get(r["edge_id"], False)
            if r["edge_id"] in was:
                was[r["edge_id"]] = r["type"] != "remove_edge"
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_no_updates(spark):
    base, none = edges(spark, BASE), spark.createDataFrame([], UPDATE)
    assert updates.edge_versions(base, none).count() == 4 and updates.update_answers(base, none).count() == 0
    assert _state(updates.apply_updates(base, none)) == {(i, True, 5.0, "local") for i in range(4)}


def test_shuffled_arrival_repeated_rows_and_a_restart(spark, tmp_path):
    log, base = _log(60, 2), edges(spark, BASE)
    want = _plain(log, {i: (True, 5.0, "local") for i in range(4)})[1]
    shuffled = log + log[10:20]
    random.Random(2).shuffle(shuffled)

    def run(part, name):
        spark.createDataFrame(part, UPDATE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        streams.stream_edge_changes(stream, f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()

    run(shuffled[:30], "a")
    run(shuffled[30:50], "b")  # a new start goes on from the states that Spark has kept
    run(shuffled[50:], "c")
    assert _state(streams.edges_of_changes(base, f"file://{tmp_path}/out")) == want
    state = streams.EdgeState(base, f"file://{tmp_path}/state")
    for at in range(0, 70, 25):
        state.fold(spark.createDataFrame(shuffled[at : at + 25], UPDATE))
    assert _state(state.edges()) == want and _state(state.edges(0)) == {(i, True, 5.0, "local") for i in range(4)}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    log, base = _log(40, 0), edges(spark, BASE)
    one, two = (spark.createDataFrame(part, UPDATE) for part in (log[:20], log[20:]))
    state = streams.EdgeState(base, f"file://{tmp_path}/s")
    for batch, number in ((one, 0), (one, 0), (two, 1), (two, 1)):
        before = _state(state.edges(number))
        state.fold(batch, number)
        assert _state(state.edges(number)) == before
    assert _state(state.edges()) == _plain(log, {i: (True, 5.0, "local") for i in range(4)})[1] and graph.cut(state.edges()).count() == 4
