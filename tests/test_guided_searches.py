"""Searches bounded by landmark tables: the same answers from fewer labels."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from wayloom.operators import cells, graph, landmarks, search


def _town(spark, wide, lengths, rng):
    """A grid whose streets have random lengths; every fifth is one-way."""
    ways = []
    for x, y in itertools.product(range(wide), range(wide)):
        for dx, dy in ((1, 0), (0, 1)):
            if x + dx < wide and y + dy < wide:
                a, b, w = x * wide + y, (x + dx) * wide + y + dy, rng.choice(lengths)
                ways.append((a, b, w, rng.choice(["local", "primary"])))
                if rng.random() > 0.2:
                    ways.append((b, a, w, "local"))
    nodes = spark.createDataFrame([(x * wide + y, float(x), float(y)) for x in range(wide) for y in range(wide)] + [(10**6, 0.0, 0.0)], "id long, lat double, lon double")
    return nodes, graph.cut(spark.createDataFrame(ways, "src long, dst long, length double, road_type string"))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _counted(monkeypatch, run):
    """The answers of ``run`` and how many entries its rounds kept."""
    kept, plain = [0], graph.cut

    def cut(df, *rest):
        out = plain(df, *rest)
        if {"search_id", "node", "cell", "path"} <= set(out.columns) and "way" not in out.columns:
            kept[0] += out.count()
        return out

    with monkeypatch.context() as m:
        m.setattr(graph, "cut", cut)
        return run(), kept[0]


def test_same_answers_from_fewer_labels(spark, monkeypatch):
    rng = random.Random(11)
    # tenths are not exact in binary and make ties of sums in different order; 0 makes cycles of no length
    nodes, adj = _town(spark, 16, [0.0, 0.1, 0.2, 0.3, 0.7, 1.0], rng)
    tables = graph.cut(landmarks.landmark_distances(adj, landmarks.select_landmarks(adj, 4)))
    asked = []
    for i in range(60):
        s, t = rng.randrange(256), rng.choice([rng.randrange(256), 10**6, 7 if i % 9 else 999])
        asked.append((i, s, t, [rng.randrange(256)] if i % 4 == 1 else None, ["primary"] if i % 5 == 2 else None, [(s, s + 1)] if i % 6 == 3 else None))
    searches = spark.createDataFrame(asked, "search_id long, source long, target long, forbidden_nodes array<long>, forbidden_road_types array<string>, forbidden_edges array<struct<u:long,v:long>>")
    where = cells.assign(nodes, 16)
    plain, all_ = _counted(monkeypatch, lambda: _rows(search.shortest_paths(nodes, adj, searches, where=where)))
    guided, some = _counted(monkeypatch, lambda: _rows(search.shortest_paths(nodes, adj, searches, where=where, tables=tables)))
    assert guided == plain and sum(r[1] for r in plain) > 20
    assert some < 0.8 * all_, (some, all_)


def test_tables_count_only_where_they_hold(spark):
    # from seq 5 on a new short way exists: tables of the first edges would hide it
    live = [(i, i + 1, 10.0, "a", -1, 9**9) for i in range(20)] + [(0, 30, 1.0, "a", 5, 9**9), (30, 20, 1.0, "a", 5, 9**9), (30, 19, 50.0, "a", -1, 9**9)]
    adj = spark.createDataFrame(live, "src long, dst long, length double, road_type string, valid_from long, valid_to long")
    nodes = spark.createDataFrame([(i,) for i in range(31)], "id long")
    first = graph.cut(adj.filter("valid_from < 5"))
    tables = graph.cut(landmarks.landmark_distances(first, landmarks.select_landmarks(first, 3)))
    asked = spark.createDataFrame([(1, 0, 20, 3), (2, 0, 20, 7), (3, 30, 20, 1), (4, 30, 20, 9)], "search_id long, source long, target long, seq long")
    want = {1: (200.0, list(range(21))), 2: (2.0, [0, 30, 20]), 3: (60.0, [30, 19, 20]), 4: (1.0, [30, 20])}
    for told in (asked, asked.withColumn("held", F.col("seq") < 5), asked.withColumn("held", F.lit(None).cast("boolean"))):
        got = search.shortest_paths(nodes, adj, told, tables=tables, where=cells.assign(nodes, 4))
        assert {r["search_id"]: (r["cost"], r["path"]) for r in got.collect()} == want


def test_empty_tables_and_searches(spark):
    nodes, adj = _town(spark, 3, [1.0], random.Random(1))
    tables = landmarks.landmark_distances(adj, landmarks.select_landmarks(adj, 2))
    asked = spark.createDataFrame([(1, 0, 8)], "search_id long, source long, target long")
    plain = _rows(search.shortest_paths(nodes, adj, asked))
    assert _rows(search.shortest_paths(nodes, adj, asked, tables=tables.limit(0))) == plain
    assert search.shortest_paths(nodes, adj, asked.limit(0), tables=tables).count() == 0


def test_labels_followed_inside_a_cell():
    wide, rng, out = 30, random.Random(5), {}
    for a in range(wide * wide):
        for b in (a + 1 if (a + 1) % wide else None, a + wide if a + wide < wide * wide else None):
            if b is not None:
                w = rng.choice([1.0, 2.0, 3.0])
                for u, v in ((a, b), (b, a)):
                    out.setdefault(u, []).append((v, 0, w.__add__, None, None, None))
    target = wide * 15 + 22
    ends = (0, wide * wide - 1, wide - 1)
    table = [cells.follow([(0.0, (e,))], out, 0, None, None, None, False)[0] for e in ends]
    import numpy as np

    h = np.array([[t[v][0] for t in table] for v in range(wide * wide)])
    still = cells._still((list(range(wide * wide)), h, h), [t[target][0] for t in table], [t[target][0] for t in table])
    start = wide * 15 + 5
    best = min(t[start][0] + t[target][0] for t in table)
    plain = cells.follow([(0.0, (start,))], out, 0, None, target, None, True)[0]
    guided = cells.follow([(0.0, (start,))], out, 0, None, target, best, True, still)[0]
    assert guided[target] == plain[target] and len(guided) < len(plain)


def test_distances_to_many_lists_of_targets(spark, monkeypatch):
    from wayloom.functions import geo

    nodes = spark.createDataFrame([(i, 19.0 + i / 100, 72.0 + i % 7 / 50) for i in range(40)], "id long, lat double, lon double")
    targets = spark.createDataFrame([(i % 31,) for i in range(60)] + [(99,)], "target long")
    one = _rows(geo.distances_to(nodes, targets))
    monkeypatch.setattr(geo, "LISTED", 5)
    assert _rows(geo.distances_to(nodes, targets)) == one and len(one) == 40 * 32
    assert geo.distances_to(nodes, targets.limit(0)).count() == 0
