"""Road tables derived from the customer, orders and events tables, in SQL that Spark and DuckDB share.

A text names its inputs in braces. ``spark(...)`` runs one with DataFrames for
them; ``ctes(...)`` gives the DuckDB WITH list for some of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("customer", "orders", "events")

PRIORITY_TYPE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'expressway' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'secondary' WHEN '4-NOT SPECIFIED' THEN 'tertiary' ELSE 'local' END"
SPEED = "CAST(CASE road_type WHEN 'expressway' THEN 27.78 WHEN 'primary' THEN 16.67 WHEN 'secondary' THEN 13.89 WHEN 'tertiary' THEN 11.11 ELSE 8.33 END AS DOUBLE)"
FACTOR = "(CAST(0.8 AS DOUBLE) + ((id * 31 + s * 17) % 41) / CAST(100 AS DOUBLE))"

SQL: dict[str, str] = {
    "nodes": """
SELECT c_custkey AS id,
       CAST(19.06 AS DOUBLE) + CAST(floor(c_custkey / 32.0) AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lat,
       CAST(72.85 AS DOUBLE) + (c_custkey % 32) * CAST(0.001 AS DOUBLE) + (c_custkey * 37 % 11) * CAST(0.00001 AS DOUBLE) AS lon,
       CASE WHEN c_custkey % 7 <> 0 THEN NULL
            WHEN c_mktsegment = 'HOUSEHOLD' THEN 'restaurant' WHEN c_mktsegment = 'FURNITURE' THEN 'hotel'
            WHEN c_mktsegment = 'MACHINERY' THEN 'petrol station' WHEN c_mktsegment = 'BUILDING' THEN 'hospital'
            ELSE 'atm' END AS poi
FROM {customer}""",
    "edges": f"""
SELECT f.k AS id, f.u, f.v, f.road_type, f.oneway,
       round(CAST(2 * 6371000.0 AS DOUBLE) * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
         + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))
         * (1 + (CASE WHEN f.road_type = 'expressway' THEN 0 ELSE f.k % 20 END) / CAST(100 AS DOUBLE)), 3) AS length
FROM (SELECT r.*, row_number() OVER (PARTITION BY u, v ORDER BY k) AS rn
      FROM (SELECT o_orderkey AS k, o_custkey AS u,
                   o_custkey + (CASE WHEN o_orderpriority = '1-URGENT' THEN (CASE WHEN o_orderkey % 2 = 0 THEN 8 ELSE 256 END)
                                     ELSE (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 32 END) END)
                             * (CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE -1 END) AS v,
                   {PRIORITY_TYPE} AS road_type, o_orderkey % 5 = 0 AS oneway
            FROM {{orders}}) r
      WHERE v >= 0 AND v < (SELECT count(*) FROM {{nodes}})) f
JOIN {{nodes}} a ON a.id = f.u JOIN {{nodes}} b ON b.id = f.v
WHERE rn = 1""",
    "adj": f"""
SELECT id AS edge_id, u AS src, v AS dst, length, road_type, round(length / {SPEED}, 3) AS avg_time FROM {{edges}}
UNION ALL
SELECT id, v, u, length, road_type, round(length / {SPEED}, 3) FROM {{edges}} WHERE NOT oneway""",
    "updates": """
SELECT event_id AS seq, event_id AS id, CASE event_type WHEN 'error' THEN 'remove_edge' ELSE 'modify_edge' END AS type,
       (event_id * 7919) % (SELECT count(*) FROM {orders}) AS edge_id,
       CASE WHEN event_type = 'purchase' AND event_id % 25 <> 0 THEN round(value + 50, 3) END AS p_length,
       CASE WHEN event_type = 'signup' THEN 'local' END AS p_road_type
FROM {events} WHERE event_type IN ('error', 'purchase', 'signup') AND event_id % 5 = 0""",
    "hot_updates": """
SELECT e.event_id AS seq, e.event_id AS id, CASE e.event_type WHEN 'error' THEN 'remove_edge' ELSE 'modify_edge' END AS type,
       h.id AS edge_id,
       CASE WHEN e.event_type = 'purchase' AND e.event_id % 3 <> 0 THEN round(e.value + 50, 3) END AS p_length,
       CASE WHEN e.event_type = 'signup' THEN 'local' END AS p_road_type
FROM {events} e JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM {edges}) h ON h.n = e.event_id % 20
WHERE e.event_type IN ('error', 'purchase', 'signup') AND e.event_id % 7 = 0""",
    "path_requests": """
SELECT event_id AS id, event_id AS seq, user_id * 7 % (SELECT count(*) FROM {nodes}) AS source,
       (user_id * 7 + 65 + event_id % 97) % (SELECT count(*) FROM {nodes}) AS target,
       CASE event_type WHEN 'click' THEN 'distance' ELSE 'time' END AS mode,
       CASE WHEN event_id % 300 = 0 THEN 'expressway' END AS forbidden_road_type,
       CASE WHEN event_id % 400 = 0 THEN (user_id * 7 + 33) % (SELECT count(*) FROM {nodes}) END AS forbidden_node
FROM {events} WHERE event_type IN ('click', 'view') AND event_id % 100 = 0""",
    "knn_requests": """
SELECT event_id AS id, event_id AS seq,
       CASE event_id % 5 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'hotel' WHEN 2 THEN 'petrol station' WHEN 3 THEN 'hospital' ELSE 'atm' END AS poi,
       CAST(19.06 AS DOUBLE) + (event_id * 13 % 47) * CAST(0.001 AS DOUBLE) + CAST(0.0003 AS DOUBLE) AS lat,
       CAST(72.85 AS DOUBLE) + (event_id * 29 % 32) * CAST(0.001 AS DOUBLE) + CAST(0.0004 AS DOUBLE) AS lon,
       CAST(event_id % 6 AS INT) AS k,
       CASE WHEN event_id % 2 = 0 THEN 'euclidean' ELSE 'shortest_path' END AS metric
FROM {events} WHERE event_type = 'signup' AND event_id % 31 = 0""",
    "kpath_requests": """
SELECT event_id AS id, user_id * 7 % (SELECT count(*) FROM {nodes}) AS source,
       (user_id * 7 + 33 + event_id % 5) % (SELECT count(*) FROM {nodes}) AS target,
       CAST(2 + event_id % 4 AS INT) AS k, CAST(20 + event_id % 61 AS DOUBLE) AS overlap_threshold
FROM {events} WHERE event_type = 'click' AND event_id % 150 = 0""",
    "approx_requests": """
SELECT event_id AS pair_id, user_id * 7 % (SELECT count(*) FROM {nodes}) AS source,
       (user_id * 11 + event_id) % (SELECT count(*) FROM {nodes}) AS target,
       CAST(5 * (1 + event_id % 3) AS DOUBLE) AS acceptable_error_pct
FROM {events} WHERE event_type = 'view' AND event_id % 50 = 0""",
    "fleet_orders": """
SELECT event_id AS id, j AS order_id, CAST(1 + event_id % 3 AS INT) AS num_drivers, event_id * 7 % (SELECT count(*) FROM {nodes}) AS depot_node,
       (event_id * 37 + j * 101) % (SELECT count(*) FROM {nodes}) AS pickup, (event_id * 53 + j * 211 + 17) % (SELECT count(*) FROM {nodes}) AS dropoff
FROM {events} JOIN (SELECT 1 AS j UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) o
  ON j <= 1 + floor(event_id / 100) % 5
WHERE event_type = 'purchase' AND event_id % 100 = 0""",
}

NEEDS = {name: [n for n in (*BASE, *SQL) if "{" + n + "}" in text] for name, text in SQL.items()}


class Tables:
    """The derived tables of one data folder, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in SQL:
                df = self.spark.sql(SQL[name], **{n: self[n] for n in NEEDS[name]})
            else:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self.made[name] = df
        return self.made[name]

    def stored(self, name: str) -> DataFrame:
        """A table that several steps read, run once and kept."""
        from ..operators.graph import cut

        if name not in SQL or getattr(self[name], "_stored", False):
            return self[name]
        self.made[name] = cut(self[name])
        self.made[name]._stored = True
        return self.made[name]

    def pois(self) -> DataFrame:
        """nodes with ``pois``, their places of interest as an array."""
        return self.stored("nodes").selectExpr("id", "lat", "lon", "CASE WHEN poi IS NULL THEN cast(array() AS array<string>) ELSE array(poi) END AS pois")

    def profiled(self) -> DataFrame:
        """edges with a 96-slot speed profile and mean time, spread over tasks by work rather than bytes."""
        return self.stored("edges").repartition(self.spark.sparkContext.defaultParallelism, "id").selectExpr("*", f"transform(sequence(0L, 95L), s -> round({SPEED} * {FACTOR}, 4)) AS speed_profile", f"round(length / {SPEED}, 3) AS avg_time", "true AS active")


def ctes(*names: str) -> list[str]:
    """DuckDB CTEs for the named tables and what they need, in order."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BASE or name in out:
            return
        for n in NEEDS[name]:
            add(n)
        out[name] = f"{name} AS MATERIALIZED ({SQL[name].format(**{n: n for n in NEEDS[name]})})"

    for name in names:
        add(name)
    return list(out.values())
