"""Speed profiles kept once a cell, and edges of a cell by their source."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import cells, search


def test_a_cell_holds_each_profile_once_and_times_are_exact(spark, monkeypatch):
    rng = random.Random(8)
    kinds = [[float(rng.randint(1, 20)) for _ in range(n)] for n in (1, 4, 96)]
    ways = [(a, b, float(rng.randint(50, 900)), kinds[rng.randrange(3)]) for a in range(24) for b in (a + 1, a + 5, a - 1) if 0 <= b < 24]
    adj = spark.createDataFrame(ways, "src long, dst long, length double, speed_profile array<double>")
    nodes = spark.createDataFrame([(i,) for i in range(24)], "id long")
    held, lists = cells.profiles(adj.withColumn("_v", geo.profile_speeds(F.col("speed_profile"))).drop("speed_profile"))
    assert lists.count() == 3
    where = cells.assign(nodes, 8)
    rows = cells.timed(cells.packed(held, where, ["src", "dst", "length", "profile"]), lists, geo.SLOT_WIDTH).collect()
    assert sum(len(r["src"]) for r in rows) == len(ways) and all(sum(r["p_size"]) == len(r["p_v"]) == len(r["p_c"]) <= 101 for r in rows)
    monkeypatch.setattr(cells, "PROFILE_VALUES", 50)
    assert cells.nodes_of_timed_cells(lists, 24) == 11

    def earliest(source):
        clock = {source: 0.0}
        for _ in ways:
            for a, b, m, p in ways:
                if a in clock:
                    sums = [sum((v * geo.SLOT_WIDTH for v in p[:k]), 0.0) for k in range(len(p))]
                    clock[b] = min(clock.get(b, 1e18), cells.arrival(clock[a], m, p, sums, geo.SLOT_WIDTH))
        return clock

    asked = spark.createDataFrame([(10 * s + t, s, t) for s in (0, 3) for t in (7, 23)], "search_id long, source long, target long")
    for r in search.shortest_paths(nodes, adj, asked, "time").collect():
        want = earliest({7: 0, 23: 0, 37: 3, 53: 3}[r["search_id"]])[7 if r["search_id"] in (7, 37) else 23]
        assert abs(r["cost"] - want) < 1e-6
