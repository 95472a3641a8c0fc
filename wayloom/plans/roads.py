"""Registered road queries and their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, paths
from ..operators import cells, components, fleet, graph, ingest, knn, kpaths, landmarks, overlay, search, updates
from ..streaming import streams
from . import events as plan
from .fixtures import SPEED, Tables, ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rounds of the oracle's searches: more than any best path has edges at the size it runs on.
ROUNDS = 34


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(parts: list[str], last: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + last


def bellman_ford(searches: str, adj: str, weight: str = "a.length", allowed: str = "true", rounds: int = ROUNDS) -> list[str]:
    """CTEs ``d0`` ... : best (cost, path) of each search and node after so many edges."""
    out = [f"d0 AS MATERIALIZED (SELECT search_id, source AS node, {{'cost': CAST(0 AS DOUBLE), 'path': [source]}} AS b FROM {searches})"]
    for i in range(rounds):
        out.append(
            f"d{i + 1} AS MATERIALIZED (SELECT search_id, node, min(b) AS b FROM (SELECT search_id, node, b FROM d{i} UNION ALL "
            f"SELECT d.search_id, a.dst, {{'cost': d.b.cost + {weight}, 'path': list_append(d.b.path, a.dst)}} FROM d{i} d JOIN {searches} s ON s.search_id = d.search_id "
            f"JOIN {adj} a ON a.src = d.node WHERE {allowed}) GROUP BY search_id, node)"
        )
    return out


# --- scalar functions and graph building -------------------------------------------------


@query(_with(ctes("nodes", "edges"), """
SELECT e.id, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 4) AS metres,
       round(((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) * 1000000, 6) AS deg2
FROM edges e JOIN nodes a ON a.id = e.u JOIN nodes b ON b.id = e.v"""))
def edge_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F3, J2."""
    t = Tables(spark, sf_dir)
    a, b = (t["nodes"].select(F.col("id").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon")) for k in ("u", "v"))
    ends = [F.col(c) for c in ("u_lat", "u_lon", "v_lat", "v_lon")]
    return t["edges"].join(a, "u").join(b, "v").select("id", F.round(geo.haversine_m(*ends), 4).alias("metres"), F.round(geo.deg2(*ends) * 1000000, 6).alias("deg2"))


@query(_with(ctes("nodes"), """
SELECT t.id AS target, n.id, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(t.lat - n.lat) / 2), 2) + cos(radians(n.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - n.lon) / 2), 2))), 6) AS km
FROM nodes n, nodes t WHERE t.id IN (3, 77)"""))
def distances_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2."""
    t = Tables(spark, sf_dir)
    wanted = t["nodes"].filter("id IN (3, 77)").select(F.col("id").alias("target"))
    return geo.distances_to(t["nodes"], wanted).withColumn("km", F.round("km", 6))


_PROFILE = f"list_transform(range(96), lambda s: round({SPEED} * (CAST(0.8 AS DOUBLE) + ((id * 31 + s * 17) % 41) / CAST(100 AS DOUBLE)), 4))"
_TIMED = [
    f"timed AS MATERIALIZED (SELECT id, u, v, oneway, road_type, length, {_PROFILE} AS sp FROM edges)",
    "summed AS MATERIALIZED (SELECT *, list_transform(range(96), lambda i: coalesce(list_sum(list_transform(sp[1:i], lambda x: x * 15.0)), 0.0)) AS cum FROM timed)",
]


def _arrival(t: str, a: str) -> str:
    k0 = f"(1 + least(CAST(floor({t} / 15.0) AS INT), 95))"
    goal = f"({a}.cum[{k0}] + {a}.sp[{k0}] * ({t} - 15.0 * ({k0} - 1)) + {a}.length)"
    k1 = f"len(list_filter({a}.cum, lambda c: c <= {goal}))"
    return f"(15.0 * ({k1} - 1) + ({goal} - {a}.cum[{k1}]) / {a}.sp[{k1}])"


@query(_with(ctes("edges") + _TIMED, f"SELECT a.id, round({_arrival('(CAST(a.id % 1500 AS DOUBLE))', 'a')}, 6) AS arrival FROM summed a"))
def edge_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F5."""
    e = Tables(spark, sf_dir).profiled().withColumn("sp", geo.profile_speeds(F.col("speed_profile"))).withColumn("cum", geo.profile_cumsum(F.col("sp")))
    start = (F.col("id") % 1500).cast("double")
    return e.select("id", F.round(geo.arrival_time(start, F.col("length"), F.col("sp"), F.col("cum")), 6).alias("arrival"))


@query(_with(ctes("adj"), "SELECT edge_id, src, dst, length, road_type, avg_time FROM adj"))
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P4, P5, X1."""
    t = Tables(spark, sf_dir)
    e = graph.valid_edges(graph.normalize_edges(t["edges"].withColumn("average_time", F.expr(f"round(length / {SPEED}, 3)"))), t["nodes"])
    return graph.adjacency(graph.fill_speed_profile(e)).select("edge_id", "src", "dst", "length", "road_type", "avg_time")


@query(_with(ctes("adj"), "SELECT src, count(*) AS out_degree FROM adj GROUP BY src"))
def out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return graph.degree(graph.adjacency(Tables(spark, sf_dir)["edges"]))


@query(_with(ctes("adj"), """
SELECT src, dst, min(length) AS length, arg_min(edge_id, {'l': length, 'e': edge_id}) AS edge_id, arg_min(edge_id, {'p': (edge_id * 7919) % 1000003, 'e': edge_id}) AS first_id FROM adj GROUP BY src, dst"""))
def edge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest edge of each pair, and the first in an input order that is not that of the ids."""
    adj = graph.adjacency(Tables(spark, sf_dir)["edges"].withColumn("pos", F.expr("(id * 7919) % 1000003")))
    return graph.collapse(adj).join(graph.first_seen(adj).withColumnRenamed("edge_id", "first_id"), ["src", "dst"])


@query(_with(ctes("edges"), f"SELECT id, round(CASE WHEN id % 3 = 0 THEN length / 13.8 ELSE round(length / {SPEED}, 3) END, 6) AS edge_time FROM edges"))
def edge_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every third edge without a mean time."""
    e = Tables(spark, sf_dir)["edges"].withColumn("avg_time", F.expr(f"CASE WHEN id % 3 = 0 THEN 0.0D ELSE round(length / {SPEED}, 3) END"))
    return e.select("id", F.round(geo.edge_time(F.col("avg_time"), F.col("length")), 6).alias("edge_time"))


# --- searches ------------------------------------------------------------------------------

_SEARCHES = "searches AS MATERIALIZED (SELECT id AS search_id, * FROM path_requests WHERE mode = '{}')"
_OK = "coalesce(a.road_type <> s.forbidden_road_type, true) AND coalesce(a.dst <> s.forbidden_node, true)"
_ANSWER = (
    "SELECT s.search_id, d.b IS NOT NULL AS possible, round(d.b.cost, 6) AS cost, array_to_string(d.b.path, ',') AS path FROM searches s "
    "LEFT JOIN d{n} d ON d.search_id = s.search_id AND d.node = s.target AND coalesce(s.source <> s.forbidden_node, true)"
)


def _asked(t: Tables, mode: str) -> DataFrame:
    own = t["path_requests"].filter(F.col("mode") == mode)
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    return graph.cut(own.select(F.col("id").alias("search_id"), "source", "target", listed("forbidden_node").alias("forbidden_nodes"), listed("forbidden_road_type").alias("forbidden_road_types")))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("search_id", "possible", F.round("cost", 6).alias("cost"), F.array_join("path", ",").alias("path"))


@query(_with(ctes("adj", "path_requests") + [_SEARCHES.format("distance")] + bellman_ford("searches", "adj", allowed=_OK), _ANSWER.format(n=ROUNDS)))
def shortest_paths_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G5, J1, J3, P6-P11, A1."""
    t = Tables(spark, sf_dir)
    return _shown(search.shortest_paths(t.stored("nodes"), graph.adjacency(t.stored("edges")), _asked(t, "distance")))


@query(_with(ctes("adj", "path_requests") + [_SEARCHES.format("distance")] + bellman_ford("searches", "adj", allowed=_OK), _ANSWER.format(n=ROUNDS)))
def shortest_paths_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 with F12: bounds of four landmarks leave out nodes that cannot lie on a best path; constraints included."""
    t = Tables(spark, sf_dir)
    adj, nodes = graph.cut(graph.adjacency(t.stored("edges"))), t.stored("nodes")
    tables = graph.cut(landmarks.landmark_distances(adj, graph.cut(landmarks.select_landmarks(adj, 4))))
    return _shown(search.shortest_paths(nodes, adj, _asked(t, "distance"), tables=tables))


@query(_with(ctes("adj", "path_requests") + [_SEARCHES.format("distance")] + bellman_ford("searches", "adj", allowed=_OK), _ANSWER.format(n=ROUNDS)))
def shortest_paths_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G5, J1, A1 over cells of 256 nodes: more rounds, the same answers."""
    t = Tables(spark, sf_dir)
    return _shown(search.shortest_paths(t.stored("nodes"), graph.adjacency(t.stored("edges")), _asked(t, "distance"), where=cells.assign(t.stored("nodes"), 256), homes=[cells.assign(t.stored("nodes"), n) for n in cells.HOME_NODES]))


#: Every seventh two-way edge costs nothing: many ways of equal cost, and cycles of none.
_FREE = "fadj AS MATERIALIZED (SELECT src, dst, CASE WHEN edge_id % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE ceil(length / 250) * 250 END AS length, road_type FROM adj)"
_SIMPLE = _OK + " AND NOT list_contains(d.b.path, a.dst)"


@query(_with(ctes("adj", "path_requests") + [_FREE, _SEARCHES.format("distance")] + bellman_ford("searches", "fadj", allowed=_SIMPLE), _ANSWER.format(n=ROUNDS)))
def shortest_paths_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G5, D15 on lengths in steps of 250 metres with edges of length 0: the smallest path among many of equal cost."""
    t = Tables(spark, sf_dir)
    free = graph.adjacency(t.stored("edges")).withColumn("length", F.expr("CASE WHEN edge_id % 7 = 0 THEN 0.0D ELSE cast(ceil(length / 250) * 250 AS double) END"))
    return _shown(search.shortest_paths(t.stored("nodes"), free, _asked(t, "distance")))


_TIME_ADJ = "tadj AS MATERIALIZED (SELECT u AS src, v AS dst, length, road_type, sp, cum FROM summed UNION ALL SELECT v, u, length, road_type, sp, cum FROM summed WHERE NOT oneway)"


@query(_with(ctes("edges", "path_requests") + _TIMED + [_TIME_ADJ, _SEARCHES.format("time")] + bellman_ford("searches", "tadj", f"({_arrival('d.b.cost', 'a')} - d.b.cost)", _OK), _ANSWER.format(n=ROUNDS).replace("round(d.b.cost, 6)", "round(d.b.cost, 4)")))
def shortest_paths_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, F4."""
    t = Tables(spark, sf_dir)
    found = search.shortest_paths(t.stored("nodes"), graph.adjacency(t.profiled()), _asked(t, "time"), "time")
    return _shown(found).withColumn("cost", F.round("cost", 4))


@query(_with(ctes("adj", "path_requests") + [_SEARCHES.format("distance")] + bellman_ford("searches", "adj", "a.avg_time", _OK), _ANSWER.format(n=ROUNDS)))
def shortest_paths_avg_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, F6."""
    t = Tables(spark, sf_dir)
    return _shown(search.shortest_paths(t.stored("nodes"), graph.adjacency(t.profiled().drop("speed_profile")), _asked(t, "distance"), "avg_time"))


_THREE = "(VALUES (1, 5), (2, 70), (3, 111)) v(search_id, source)"


@query(_with(ctes("adj") + [f"searches AS MATERIALIZED (SELECT * FROM {_THREE})"] + bellman_ford("searches", "adj"), f"SELECT search_id, node, round(b.cost, 6) AS cost FROM d{ROUNDS}"))
def single_source_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: from three customers to all they reach."""
    t = Tables(spark, sf_dir)
    sources = t["nodes"].filter("id IN (5, 70, 111)").selectExpr("CASE id WHEN 5 THEN 1 WHEN 70 THEN 2 ELSE 3 END AS search_id", "id AS source")
    return search.sssp(graph.adjacency(t.stored("edges")), sources).withColumn("cost", F.round("cost", 6))


_VERSIONS = """versions AS MATERIALIZED (
  SELECT e.id, e.u, e.v, e.oneway, e.road_type, e.length, true AS active, CAST(-1 AS BIGINT) AS valid_from, coalesce((SELECT min(seq) FROM {up} h WHERE h.edge_id = e.id), 9223372036854775807) AS valid_to FROM edges e
  UNION ALL
  SELECT e.id, e.u, e.v, e.oneway, coalesce(last_value(h.p_road_type IGNORE NULLS) OVER w, e.road_type), coalesce(last_value(h.p_length IGNORE NULLS) OVER w, e.length), h.type <> 'remove_edge', h.seq,
         coalesce(lead(h.seq) OVER (PARTITION BY h.edge_id ORDER BY h.seq), 9223372036854775807)
  FROM {up} h JOIN edges e ON e.id = h.edge_id
  WINDOW w AS (PARTITION BY h.edge_id ORDER BY h.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_LIVE = "vadj AS MATERIALIZED (SELECT u AS src, v AS dst, length, road_type, valid_from, valid_to FROM versions WHERE active UNION ALL SELECT v, u, length, road_type, valid_from, valid_to FROM versions WHERE active AND NOT oneway)"


@query(_with(ctes("edges", "path_requests", "updates") + [_VERSIONS.format(up="updates"), _LIVE, _SEARCHES.format("distance")] + bellman_ford("searches", "vadj", allowed=_OK + " AND a.valid_from <= s.seq AND s.seq < a.valid_to"), _ANSWER.format(n=ROUNDS)))
def shortest_paths_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request sees the graph as of its place in the log."""
    t = Tables(spark, sf_dir)
    versions = graph.cut(updates.edge_versions(t.stored("edges"), t["updates"]))
    asked = _asked(t, "distance").withColumn("seq", F.col("search_id"))
    return _shown(search.shortest_paths(t.stored("nodes"), graph.adjacency(versions), asked))


# --- updates --------------------------------------------------------------------------------

_STATE = """SELECT h.*, e.id AS known, coalesce(lag(h.type <> 'remove_edge') OVER (PARTITION BY h.edge_id ORDER BY h.seq), e.id IS NOT NULL) AS was, (p_length IS NOT NULL OR p_road_type IS NOT NULL) AS patch
FROM {up} h LEFT JOIN edges e ON e.id = h.edge_id"""
_ANSWERS = """SELECT seq, id, type, edge_id, CASE WHEN type = 'remove_edge' THEN known IS NOT NULL AND was END AS removed,
       CASE WHEN type <> 'remove_edge' THEN known IS NOT NULL AND NOT (was AND NOT patch) END AS done,
       CASE WHEN type = 'remove_edge' AND known IS NULL THEN 'edge not found' END AS error FROM ({}) q"""


@query(_with(ctes("edges", "updates"), _ANSWERS.format(_STATE.format(up="updates"))))
def update_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U2, J5."""
    t = Tables(spark, sf_dir)
    return updates.update_answers(t.stored("edges"), t["updates"])


@query(_with(ctes("edges", "hot_updates"), _ANSWERS.format(_STATE.format(up="hot_updates"))))
def hot_update_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U2, W3 over long chains."""
    t = Tables(spark, sf_dir)
    return updates.update_answers(t.stored("edges"), t["hot_updates"])


@query(_with(ctes("edges", "hot_updates") + [_VERSIONS.format(up="hot_updates")], "SELECT id, u, v, road_type, oneway, length, active, valid_from, valid_to FROM versions"))
def edge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3, W2, W4."""
    t = Tables(spark, sf_dir)
    out = updates.edge_versions(t.stored("edges"), t["hot_updates"])
    return out.withColumn("valid_from", F.greatest("valid_from", F.lit(-1).cast("long")))


_FINAL = "SELECT id, u, v, road_type, oneway, length, active FROM versions WHERE valid_to = 9223372036854775807"


@query(_with(ctes("edges", "hot_updates") + [_VERSIONS.format(up="hot_updates")], _FINAL))
def final_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5."""
    t = Tables(spark, sf_dir)
    return updates.apply_updates(t.stored("edges"), t["hot_updates"])


@query(_with(ctes("edges", "hot_updates") + [_VERSIONS.format(up="hot_updates")], _FINAL))
def streamed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream over files that hold the updates out of order, a file to a batch."""
    t = Tables(spark, sf_dir)
    root, log = graph.shared_dir(spark), t["hot_updates"]
    log.repartition(3, F.xxhash64("seq")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    streams.stream_edge_changes(stream, f"{root}/changes").option("checkpointLocation", f"{root}/at").trigger(availableNow=True).start().awaitTermination()
    return streams.edges_of_changes(t.stored("edges"), f"{root}/changes").select("id", "u", "v", "road_type", "oneway", "length", "active")


# --- nearest nodes ---------------------------------------------------------------------------

_D2 = "((q.lat - n.lat) * (q.lat - n.lat) + (q.lon - n.lon) * (q.lon - n.lon))"
_NEAR = f"SELECT q.id, n.id AS node, row_number() OVER (PARTITION BY q.id ORDER BY {_D2}, n.id) AS rank, {_D2} AS d2, q.k FROM knn_requests q, nodes n"


@query(_with(ctes("nodes", "knn_requests"), f"SELECT id, node FROM ({_NEAR}) WHERE rank = 1"))
def nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, J6."""
    t = Tables(spark, sf_dir)
    return knn.nearest_node(t.pois(), t["knn_requests"].select("id", "lat", "lon"))


@query(_with(ctes("nodes", "knn_requests"), f"SELECT id, CAST(rank AS INT) AS rank, node, round(d2 * 1000000, 6) AS dist2 FROM ({_NEAR}) WHERE rank <= k"))
def k_nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, W5, L1."""
    t = Tables(spark, sf_dir)
    return knn.knn_nodes(t.pois(), t["knn_requests"].select("id", "lat", "lon", "k")).withColumn("dist2", F.round(F.col("dist2") * 1000000, 6))


@query(_with(ctes("nodes", "knn_requests"), f"SELECT id, CAST(rank AS INT) AS rank, node, round(d2 * 1000000, 6) AS dist FROM ({_NEAR} WHERE n.poi = q.poi AND q.metric = 'euclidean') WHERE rank <= k"))
def poi_knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3, J7, P3, P12."""
    t = Tables(spark, sf_dir)
    own = t["knn_requests"].filter("metric = 'euclidean'")
    return knn.poi_knn(t.pois(), graph.adjacency(t["edges"]), own).withColumn("dist", F.round(F.col("dist") * 1000000, 6))


@query(_with(
    ctes("nodes", "adj", "knn_requests")
    + [f"snapped AS MATERIALIZED (SELECT id, node FROM ({_NEAR} WHERE q.metric = 'shortest_path') WHERE rank = 1)", "searches AS MATERIALIZED (SELECT DISTINCT node AS search_id, node AS source FROM snapped)"]
    + bellman_ford("searches", "adj"),
    f"SELECT id, CAST(rank AS INT) AS rank, node, round(cost, 6) AS dist FROM (SELECT q.id, q.k, d.node, d.b.cost AS cost, row_number() OVER (PARTITION BY q.id ORDER BY d.b.cost, d.node) AS rank FROM knn_requests q JOIN snapped s ON s.id = q.id JOIN d{ROUNDS} d ON d.search_id = s.node JOIN nodes n ON n.id = d.node AND n.poi = q.poi) WHERE rank <= k"))
def poi_knn_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4."""
    t = Tables(spark, sf_dir)
    own = t["knn_requests"].filter("metric = 'shortest_path'").drop("seq")
    return knn.poi_knn(t.pois(), graph.adjacency(t.stored("edges")), own, "shortest_path").withColumn("dist", F.round("dist", 6))


# --- components, landmarks -----------------------------------------------------------------------

_SPARSE = "sadj AS MATERIALIZED (SELECT DISTINCT src, dst FROM adj WHERE road_type IN ('expressway', 'local'))"
_CLOSED = "reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, s.dst FROM reach r JOIN sadj s ON s.src = r.b)"


def _sparse(t: Tables) -> DataFrame:
    return graph.cut(graph.adjacency(t.stored("edges").filter("road_type IN ('expressway', 'local')")))


@query("WITH RECURSIVE " + ",\n".join(ctes("nodes", "adj") + [_SPARSE, _CLOSED]) + "\nSELECT x.a AS node, min(x.b) AS component_id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 over two of the road types."""
    t = Tables(spark, sf_dir)
    return components.strongly_connected_components(_sparse(t), t.stored("nodes"))


@query("WITH RECURSIVE " + ",\n".join(ctes("nodes", "adj") + [_SPARSE, _CLOSED]) + "\nSELECT component_id, count(*) AS n_nodes FROM (SELECT x.a, min(x.b) AS component_id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a) GROUP BY component_id")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    t = Tables(spark, sf_dir)
    return components.component_sizes(components.strongly_connected_components(_sparse(t), t.stored("nodes")))


@query("WITH RECURSIVE " + ",\n".join(ctes("nodes", "adj", "approx_requests") + [_SPARSE, _CLOSED]) + "\nSELECT p.pair_id, r.a IS NOT NULL AS reachable FROM approx_requests p LEFT JOIN reach r ON r.a = p.source AND r.b = p.target")
def reachable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    t = Tables(spark, sf_dir)
    return components.reachable(_sparse(t), t.stored("nodes"), t["approx_requests"].select("pair_id", "source", "target"))


_WHOLE = "sadj AS MATERIALIZED (SELECT DISTINCT src, dst FROM adj)"


@query("WITH RECURSIVE " + ",\n".join(ctes("nodes", "adj") + [_WHOLE, _CLOSED]) + "\nSELECT x.a AS node, min(x.b) AS component_id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a")
def strong_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 over all road types."""
    t = Tables(spark, sf_dir)
    return components.strongly_connected_components(graph.cut(graph.adjacency(t.stored("edges"))), t.stored("nodes"))


@query("WITH RECURSIVE " + ",\n".join(ctes("nodes", "adj") + [_WHOLE, _CLOSED]) + "\nSELECT component_id, count(*) AS n_nodes FROM (SELECT x.a, min(x.b) AS component_id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a) GROUP BY component_id")
def component_sizes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 over all road types."""
    return components.component_sizes(strong_components_all(spark, sf_dir))


@query("WITH RECURSIVE " + ",\n".join(ctes("nodes", "adj", "approx_requests") + [_WHOLE, _CLOSED]) + "\nSELECT p.pair_id, r.a IS NOT NULL AS reachable FROM approx_requests p LEFT JOIN reach r ON r.a = p.source AND r.b = p.target")
def reachable_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 over all road types."""
    t = Tables(spark, sf_dir)
    return components.reachable(graph.cut(graph.adjacency(t.stored("edges"))), t.stored("nodes"), t["approx_requests"].select("pair_id", "source", "target"))


def _farthest(n: int, rounds: int = ROUNDS) -> list[str]:
    """CTEs ``p0`` ... of each landmark and ``near0`` ... of each node's least distance from those so far."""
    out = ["p0 AS MATERIALIZED (SELECT src AS l FROM (SELECT src, count(*) AS c FROM adj GROUP BY src) ORDER BY c DESC, src LIMIT 1)"]
    for k in range(n - 1):
        last = f"l{k}_0"
        out.append(f"{last} AS MATERIALIZED (SELECT l AS node, CAST(0 AS DOUBLE) AS d FROM p{k})")
        for i in range(1, rounds + 1):
            out.append(f"l{k}_{i} AS MATERIALIZED (SELECT node, min(d) AS d FROM (SELECT * FROM {last} UNION ALL SELECT a.dst, x.d + a.length FROM {last} x JOIN adj a ON a.src = x.node) GROUP BY node)")
            last = f"l{k}_{i}"
        both = f"SELECT * FROM {last}" + (f" UNION ALL SELECT * FROM near{k - 1}" if k else "")
        out.append(f"near{k} AS MATERIALIZED (SELECT node, min(d) AS d FROM ({both}) GROUP BY node)")
        out.append(f"p{k + 1} AS MATERIALIZED (SELECT node AS l FROM near{k} WHERE d > 0 ORDER BY d DESC, node LIMIT 1)")
    return out


@query(_with(ctes("adj") + _farthest(16), " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS pos, l AS landmark FROM p{k}" for k in range(16))))
def landmark_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen landmarks."""
    return _marks(Tables(spark, sf_dir))


def _marks(t: Tables) -> DataFrame:
    """The sixteen landmarks of the tables' graph as it is now."""
    return graph.cut(landmarks.select_landmarks(graph.cut(graph.adjacency(t.stored("edges"))), 16))


def _renamed(parts: list[str], mark: str) -> list[str]:
    """The CTEs of ``bellman_ford`` under other names, so that two searches fit one query."""
    return [re.sub(r"\bd(\d+)\b", rf"{mark}\1", p) for p in parts]


@query(_with(
    ctes("nodes", "adj") + [f"searches AS MATERIALIZED (SELECT * FROM {_THREE})", "radj AS MATERIALIZED (SELECT dst AS src, src AS dst, length FROM adj)"]
    + bellman_ford("searches", "adj") + _renamed(bellman_ford("searches", "radj"), "r"),
    f"SELECT coalesce(f.search_id, t.search_id) AS search_id, coalesce(f.node, t.node) AS node, round(f.b.cost, 6) AS d_from, round(t.b.cost, 6) AS d_to FROM d{ROUNDS} f FULL JOIN r{ROUNDS} t ON t.search_id = f.search_id AND t.node = f.node"))
def landmark_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from and to three given landmarks, unfolded from the table's arrays."""
    t = Tables(spark, sf_dir)
    marks = t["nodes"].filter("id IN (5, 70, 111)").selectExpr("CASE id WHEN 5 THEN 0 WHEN 70 THEN 1 ELSE 2 END AS pos", "id AS landmark")
    tables = landmarks.landmark_distances(graph.cut(graph.adjacency(t.stored("edges"))), marks)
    flat = tables.select("node", F.posexplode(F.arrays_zip("d_from", "d_to")).alias("pos", "d")).filter("d.d_from is not null or d.d_to is not null")
    return flat.select((F.col("pos") + 1).alias("search_id"), "node", F.round("d.d_from", 6).alias("d_from"), F.round("d.d_to", 6).alias("d_to"))


@query(_with(
    ctes("adj", "approx_requests") + ["searches AS MATERIALIZED (SELECT DISTINCT source AS search_id, source FROM approx_requests)"] + bellman_ford("searches", "adj"),
    f"SELECT p.pair_id, d.b IS NOT NULL AS found, d.b IS NOT NULL AS within FROM approx_requests p LEFT JOIN d{ROUNDS} d ON d.search_id = p.source AND d.node = p.target"))
def approximate_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each estimate keeps its bound against the exact distance."""
    t = Tables(spark, sf_dir)
    adj, nodes, pairs = graph.cut(graph.adjacency(t.stored("edges"))), t.stored("nodes"), graph.cut(t["approx_requests"])
    tables, net = graph.cut(landmarks.landmark_distances(adj, _marks(t))), overlay.Overlay(nodes, adj)
    found = landmarks.approx_distances(adj, nodes, tables, pairs, net)
    exact = search.distances(nodes, adj, pairs.select(F.col("pair_id").alias("search_id"), "source", "target"), net=net)
    both = found.join(exact.select(F.col("search_id").alias("pair_id"), "cost"), "pair_id", "left").join(pairs.select("pair_id", "acceptable_error_pct"), "pair_id")
    within = (F.col("distance") >= F.col("cost") - 1e-6) & (F.col("distance") <= F.col("cost") * (1 + F.col("acceptable_error_pct") / 100) + 1e-6)
    return both.select("pair_id", (F.col("distance") >= 0).alias("found"), F.coalesce(within, F.lit(False)).alias("within"))


@query(_with(
    ctes("adj", "approx_requests") + ["searches AS MATERIALIZED (SELECT DISTINCT source AS search_id, source FROM approx_requests)"] + bellman_ford("searches", "adj"),
    f"SELECT p.pair_id, round(coalesce(d.b.cost, -1.0), 3) AS distance FROM approx_requests p LEFT JOIN d{ROUNDS} d ON d.search_id = p.source AND d.node = p.target"))
def estimates_without_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, G11 with no error allowed: an estimate stands only where both bounds meet, the others are searched."""
    t = Tables(spark, sf_dir)
    adj, nodes, pairs = graph.cut(graph.adjacency(t.stored("edges"))), t.stored("nodes"), graph.cut(t["approx_requests"])
    tables = graph.cut(landmarks.landmark_distances(adj, _marks(t)))
    found = landmarks.approx_distances(adj, nodes, tables, pairs.withColumn("acceptable_error_pct", F.lit(0.0)))
    return found.select("pair_id", F.round("distance", 3).alias("distance"))


_BOUNDS = [
    "marks AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS search_id, l AS source FROM p{k}" for k in range(16)) + ")",
    "radj AS MATERIALIZED (SELECT dst AS src, src AS dst, length FROM adj)",
    *_renamed(bellman_ford("marks", "adj"), "f"), *_renamed(bellman_ford("marks", "radj"), "r"),
    f"""bounds AS MATERIALIZED (SELECT p.pair_id, min(rs.b.cost + ft.b.cost) AS upper, greatest(0.0, max(rs.b.cost - rt.b.cost), max(ft.b.cost - fs.b.cost)) AS lower
  FROM approx_requests p JOIN marks m ON true LEFT JOIN r{ROUNDS} rs ON rs.search_id = m.search_id AND rs.node = p.source LEFT JOIN r{ROUNDS} rt ON rt.search_id = m.search_id AND rt.node = p.target
  LEFT JOIN f{ROUNDS} fs ON fs.search_id = m.search_id AND fs.node = p.source LEFT JOIN f{ROUNDS} ft ON ft.search_id = m.search_id AND ft.node = p.target GROUP BY p.pair_id)""",
    "searches AS MATERIALIZED (SELECT DISTINCT source AS search_id, source FROM approx_requests)", *bellman_ford("searches", "adj"),
]


@query(_with(
    ctes("adj", "approx_requests") + _farthest(16) + _BOUNDS,
    f"""SELECT p.pair_id, round(CASE WHEN p.source = p.target THEN 0.0 WHEN b.upper <= b.lower * (1 + p.acceptable_error_pct / 100.0) THEN b.upper ELSE coalesce(d.b.cost, -1.0) END, 3) AS distance,
  coalesce(d.b.cost <= b.upper + 0.001 AND b.lower <= d.b.cost + 0.001, false) AS bounded
  FROM approx_requests p JOIN bounds b ON b.pair_id = p.pair_id LEFT JOIN d{ROUNDS} d ON d.search_id = p.source AND d.node = p.target"""))  # fmt: skip
def estimates_with_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8-G11, F12, J11 with the errors asked for: the estimate itself, and whether the exact distance lies between the landmarks' bounds."""
    t = Tables(spark, sf_dir)
    adj, nodes, pairs = graph.cut(graph.adjacency(t.stored("edges"))), t.stored("nodes"), graph.cut(t["approx_requests"])
    tables, net = graph.cut(landmarks.landmark_distances(adj, _marks(t))), overlay.Overlay(nodes, adj)
    found = landmarks.approx_distances(adj, nodes, tables, pairs, net)
    exact = search.distances(nodes, adj, pairs.select(F.col("pair_id").alias("search_id"), "source", "target"), net=net)
    bounds = landmarks.bounds(tables, pairs)
    all_ = found.join(exact.select(F.col("search_id").alias("pair_id"), "cost"), "pair_id", "left").join(bounds.select("pair_id", "upper", "lower"), "pair_id")
    held = (F.col("cost") <= F.col("upper") + 0.001) & (F.col("lower") <= F.col("cost") + 0.001)
    return all_.select("pair_id", F.round("distance", 3).alias("distance"), F.coalesce(held, F.lit(False)).alias("bounded"))


# --- several paths, fleets, ingest, mixed logs -------------------------------------------------------


def _kpaths(t: Tables) -> DataFrame:
    return graph.cut(t["kpath_requests"])


# The k-th of the simple paths made of best way, one edge, best way bounds the k-th of all; every simple
# path within that bound, by its length so far and the exact rest, is then listed.
_K_SHORTEST = (
    [
        "cheap AS MATERIALIZED (SELECT src, dst, min(length) AS length FROM adj WHERE src <> dst GROUP BY src, dst)", "back AS MATERIALIZED (SELECT dst AS src, src AS dst, length FROM cheap)",
        "searches AS MATERIALIZED (SELECT DISTINCT source AS search_id, source FROM kpath_requests)", "ends AS MATERIALIZED (SELECT DISTINCT target AS search_id, target AS source FROM kpath_requests)",
    ]
    + bellman_ford("searches", "cheap") + _renamed(bellman_ford("ends", "back"), "r")
    + [
        f"via AS MATERIALIZED (SELECT q.id, q.k, f.b.cost + a.length + t.b.cost AS len, list_concat(f.b.path, list_reverse(t.b.path)) AS path FROM kpath_requests q JOIN d{ROUNDS} f ON f.search_id = q.source JOIN cheap a ON a.src = f.node JOIN r{ROUNDS} t ON t.search_id = q.target AND t.node = a.dst)",
        "firsts AS MATERIALIZED (SELECT id, k, len, row_number() OVER (PARTITION BY id ORDER BY len) AS r FROM (SELECT id, k, path, min(len) AS len FROM via WHERE len(list_distinct(path)) = len(path) GROUP BY id, k, path))",
        "limits AS MATERIALIZED (SELECT id, max(len) + 0.000001 AS most FROM firsts WHERE r <= k GROUP BY id, k HAVING count(*) = k)",
        f"""walk AS (
  SELECT q.id, q.k, q.target, coalesce(l.most, 1e18) AS most, q.source AS node, [q.source] AS path, CAST(0 AS DOUBLE) AS len FROM kpath_requests q LEFT JOIN limits l USING (id)
  UNION ALL
  SELECT w.id, w.k, w.target, w.most, a.dst, list_append(w.path, a.dst), w.len + a.length FROM walk w JOIN cheap a ON a.src = w.node JOIN r{ROUNDS} t ON t.search_id = w.target AND t.node = a.dst
  WHERE w.node <> w.target AND NOT list_contains(w.path, a.dst) AND w.len + a.length + t.b.cost <= w.most)""",
    ]
)


@query("WITH RECURSIVE " + ",\n".join(ctes("adj", "kpath_requests") + _K_SHORTEST) + """
SELECT id, CAST(rank AS INT) AS rank, array_to_string(path, ',') AS path, round(len, 6) AS length
FROM (SELECT id, k, path, len, row_number() OVER (PARTITION BY id ORDER BY round(len, 6), path) AS rank FROM walk WHERE node = target) WHERE rank <= k""")
def k_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2, P10, F14, W6, X3, L2."""
    t = Tables(spark, sf_dir)
    found = kpaths.k_shortest_paths(t.stored("nodes"), graph.adjacency(t.stored("edges")), _kpaths(t))
    return found.select("id", "rank", F.array_join("path", ",").alias("path"), F.round("length", 6).alias("length"))


@query()
def k_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, F7, F9-F11, W7, X2, X4."""
    t = Tables(spark, sf_dir)
    found = kpaths.k_diverse_paths(t.stored("nodes"), graph.cut(graph.adjacency(t.stored("edges"))), _kpaths(t))
    return found.select("id", "rank", F.array_join("path", ",").alias("path"), F.round("length", 6).alias("length"))


@query(_with(ctes("adj", "path_requests") + [_SEARCHES.format("distance")] + bellman_ford("searches", "adj", allowed=_OK), f"""
SELECT edge_id, count(*) AS n FROM (
  SELECT s.search_id, d.b.path[i] AS src, d.b.path[i + 1] AS dst FROM searches s JOIN d{ROUNDS} d ON d.search_id = s.search_id AND d.node = s.target AND coalesce(s.source <> s.forbidden_node, true), range(1, 200) r(i) WHERE i < len(d.b.path)) p
JOIN (SELECT src, dst, min(edge_id) AS edge_id FROM adj GROUP BY src, dst) l USING (src, dst) GROUP BY edge_id"""))
def edge_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many of the shortest paths each edge lies."""
    t = Tables(spark, sf_dir)
    adj = graph.adjacency(t.stored("edges"))
    found = search.shortest_paths(t.stored("nodes"), adj, _asked(t, "distance")).filter("possible")
    on = paths.path_edges(found, graph.first_seen(adj), ["search_id"])
    return on.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))


def _fleet(t: Tables) -> DataFrame:
    each = F.struct(F.col("order_id").cast("long").alias("order_id"), "pickup", "dropoff")
    return graph.cut(t["fleet_orders"].groupBy("id").agg(F.array_sort(F.collect_list(each)).alias("orders"), F.first("num_drivers").alias("num_drivers"), F.first("depot_node").alias("depot_node")))


@query(_with(
    ctes("adj", "fleet_orders")
    + ["stops AS MATERIALIZED (SELECT DISTINCT id, depot_node AS node FROM fleet_orders UNION SELECT id, pickup FROM fleet_orders UNION SELECT id, dropoff FROM fleet_orders)", "searches AS MATERIALIZED (SELECT DISTINCT node AS search_id, node AS source FROM stops)"]
    + bellman_ford("searches", "adj", "a.avg_time"),
    f"SELECT s.id, s.node AS src, t.node AS dst, CASE WHEN s.node = t.node THEN 0.0 ELSE round(coalesce(d.b.cost, 1e9), 6) END AS time FROM stops s JOIN stops t ON t.id = s.id LEFT JOIN d{ROUNDS} d ON d.search_id = s.node AND d.node = t.node"))
def travel_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, A10, J10."""
    t = Tables(spark, sf_dir)
    found = fleet.travel_time_matrix(graph.adjacency(t.profiled().drop("speed_profile")), fleet.stops_of(_fleet(t)), nodes=t.stored("nodes"))
    return found.withColumn("time", F.round("time", 6))


def _inserted(rounds: int = 5) -> list[str]:
    """CTEs ``g0`` ... : the couriers' stops after so many insertions, and ``b1`` ... : the cheapest insertion of each round."""
    t = lambda a, b: f"coalesce(m[concat({a}, '>', {b})], 1e9)"
    s = lambda k: f"g.stops[{k}]"
    to_p = f"{t(s('i'), 'o.p')} + CASE WHEN i < len(g.stops) THEN {t('o.p', s('i + 1'))} - {t(s('i'), s('i + 1'))} ELSE 0.0 END"
    next_to = f"{t('o.p', 'o.d')} + CASE WHEN i < len(g.stops) THEN {t('o.d', s('i + 1'))} - {t('o.p', s('i + 1'))} ELSE 0.0 END"
    later = f"{t(s('j'), 'o.d')} + CASE WHEN j < len(g.stops) THEN {t('o.d', s('j + 1'))} - {t(s('j'), s('j + 1'))} ELSE 0.0 END"
    out = [
        "pend AS MATERIALIZED (SELECT id, order_id AS o, pickup AS p, dropoff AS d FROM fleet_orders)",
        "g0 AS MATERIALIZED (SELECT DISTINCT id, c, [depot_node] AS stops, CAST([] AS BIGINT[]) AS own FROM fleet_orders, range(0, 3) r(c) WHERE c < num_drivers)",
    ]
    for n in range(rounds):
        left = "".join(f" AND NOT EXISTS (SELECT 1 FROM b{k} x WHERE x.id = o.id AND x.b.o = o.o)" for k in range(1, n + 1))
        out.append(f"""b{n + 1} AS MATERIALIZED (SELECT id, min({{'added': added, 'o': o, 'c': c, 'i': i, 'j': j, 'p': p, 'd': d}}) AS b FROM (
  SELECT g.id, o.o, g.c, i, j, o.p, o.d, ({to_p}) + CASE WHEN i = j THEN {next_to} ELSE {later} END AS added
  FROM g{n} g JOIN maps USING (id) JOIN pend o ON o.id = g.id{left}, range(1, 12) ri(i), range(1, 12) rj(j) WHERE i <= j AND j <= len(g.stops)) WHERE added < 1e9 GROUP BY id)""")
        with_p = "list_concat(g.stops[1:x.b.i], [x.b.p], g.stops[x.b.i + 1:])"
        out.append(f"""g{n + 1} AS MATERIALIZED (SELECT id, c, CASE WHEN won THEN list_concat(w[1:j + 1], [d], w[j + 2:]) ELSE stops END AS stops, CASE WHEN won THEN list_append(own, o) ELSE own END AS own FROM (
  SELECT g.id, g.c, g.stops, g.own, coalesce(x.b.c = g.c, false) AS won, {with_p} AS w, x.b.j AS j, x.b.d AS d, x.b.o AS o FROM g{n} g LEFT JOIN b{n + 1} x ON x.id = g.id))""")
    return out


@query(_with(
    ctes("adj", "fleet_orders")
    + ["stops AS MATERIALIZED (SELECT DISTINCT id, depot_node AS node FROM fleet_orders UNION SELECT id, pickup FROM fleet_orders UNION SELECT id, dropoff FROM fleet_orders)", "searches AS MATERIALIZED (SELECT DISTINCT node AS search_id, node AS source FROM stops)"]
    + bellman_ford("searches", "adj", "a.avg_time")
    + [f"times AS MATERIALIZED (SELECT s.id, s.node AS src, t.node AS dst, CASE WHEN s.node = t.node THEN 0.0 ELSE coalesce(d.b.cost, 1e9) END AS time, d.b.path AS path FROM stops s JOIN stops t ON t.id = s.id LEFT JOIN d{ROUNDS} d ON d.search_id = s.node AND d.node = t.node)",
       "maps AS MATERIALIZED (SELECT id, map_from_entries(list({'k': concat(src, '>', dst), 'v': time})) AS m FROM times GROUP BY id)"]
    + _inserted()
    + ["legs AS MATERIALIZED (SELECT g.id, g.c, k, t.time, CASE WHEN t.path IS NULL THEN [] ELSE t.path[2:] END AS more FROM g5 g, range(1, 12) r(k), times t WHERE k < len(g.stops) AND t.id = g.id AND t.src = g.stops[k] AND t.dst = g.stops[k + 1])",
       "driven AS MATERIALIZED (SELECT g.id, g.c, g.own, list_concat([g.stops[1]], flatten(coalesce(list(l.more ORDER BY l.k) FILTER (l.k IS NOT NULL), []))) AS route, coalesce(sum(l.time), 0.0) AS time FROM g5 g LEFT JOIN legs l ON l.id = g.id AND l.c = g.c GROUP BY g.id, g.c, g.own, g.stops)"],
    "SELECT id, CAST(c AS INT) AS driver_id, array_to_string(route, ',') AS route, array_to_string(own, ',') AS order_ids, round(sum(time) OVER (PARTITION BY id), 3) AS total_delivery_time_s FROM driven"))
def delivery_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2-R4, W8, W9, F13, A8, A11."""
    t = Tables(spark, sf_dir)
    planned = fleet.schedule_deliveries(t.stored("nodes"), graph.adjacency(t.profiled().drop("speed_profile")), _fleet(t))
    return planned.select("id", F.explode("assignments").alias("a"), "total_delivery_time_s").select("id", "a.driver_id", F.array_join("a.route", ",").alias("route"), F.array_join("a.order_ids", ",").alias("order_ids"), F.round("total_delivery_time_s", 3).alias("total_delivery_time_s"))


_HIGHWAY = "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'motorway' WHEN 'FURNITURE' THEN 'primary_link' WHEN 'MACHINERY' THEN 'tertiary' WHEN 'BUILDING' THEN 'steps' ELSE 'residential' END"
_WAYS = f"SELECT c_custkey AS id, {_HIGHWAY} AS highway, CASE WHEN c_custkey % 3 = 0 THEN 'yes' WHEN c_custkey % 3 = 1 THEN 'no' END AS oneway"


@query(_with(ctes("nodes") + [
    f"ways AS MATERIALIZED ({_WAYS}, [c_custkey, c_custkey + 1, c_custkey + 33, c_custkey + 1, c_custkey + 900000] AS refs FROM customer)",
    "segs AS MATERIALIZED (SELECT w.id AS way_id, i - 1 AS pos, refs[i] AS u, refs[i + 1] AS v, CASE highway WHEN 'motorway' THEN 'expressway' WHEN 'tertiary' THEN 'tertiary' ELSE 'local' END AS road_type, coalesce(oneway, 'no') = 'yes' AS oneway FROM ways w, range(1, 5) r(i) WHERE highway <> 'steps')",
    "sized AS MATERIALIZED (SELECT s.*, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS length FROM segs s JOIN nodes a ON a.id = s.u JOIN nodes b ON b.id = s.v)",
    "both_ways AS MATERIALIZED (SELECT way_id, pos, 0 AS dir, u, v, road_type, oneway, length FROM sized WHERE length >= 0.1 UNION ALL SELECT way_id, pos, 1, v, u, road_type, oneway, length FROM sized WHERE length >= 0.1 AND NOT oneway)"],
    f"SELECT u, v, road_type, oneway, round(length, 3) AS length, round(length / {SPEED}, 3) AS avg_time FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY way_id, pos, dir) AS rn FROM both_ways) WHERE rn = 1"))
def ingested_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as map nodes, a way through four of them each."""
    t = Tables(spark, sf_dir)
    ways = t["customer"].select(
        F.col("c_custkey").alias("id"), F.create_map(F.lit("highway"), F.expr(_HIGHWAY), F.lit("oneway"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'yes' WHEN c_custkey % 3 = 1 THEN 'no' END")).alias("tags"),
        F.expr("array(c_custkey, c_custkey + 1, c_custkey + 33, c_custkey + 1, c_custkey + 900000)").alias("nodes"),
    )
    nodes, edges = ingest.build_graph(t["nodes"].select("id", "lat", "lon"), ways)
    back = nodes.select(F.col("id").alias("n"), "osm_id")
    named = edges.join(back.withColumnsRenamed({"n": "u", "osm_id": "ou"}), "u").join(back.withColumnsRenamed({"n": "v", "osm_id": "ov"}), "v")
    return named.select(F.col("ou").alias("u"), F.col("ov").alias("v"), "road_type", "oneway", "length", "avg_time")


def _limits() -> Column:
    """What a path request may not use, as an event has it."""
    return F.struct(F.when(F.col("forbidden_node").isNotNull(), F.array("forbidden_node")).alias("forbidden_nodes"), F.when(F.col("forbidden_road_type").isNotNull(), F.array("forbidden_road_type")).alias("forbidden_road_types"))


@query()
def mixed_log_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13-P15, J4, X5, L3 over all kinds: updates, paths, places, several paths, estimates, deliveries, as of their places in one log."""
    t = Tables(spark, sf_dir)
    roads = t["path_requests"].select("seq", "id", F.lit("shortest_path").alias("type"), "source", "target", "mode", _limits().alias("constraints"))
    several = t["kpath_requests"].select((F.col("id") * 10 + 1).alias("seq"), "id", F.lit("k_shortest_paths").alias("type"), "source", "target", "k")
    diverse = t["kpath_requests"].select((F.col("id") * 10 + 2).alias("seq"), "id", F.lit("k_shortest_paths_heuristic").alias("type"), "source", "target", F.lit(2).alias("k"), "overlap_threshold")
    pair = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    near = t["approx_requests"].select((F.col("pair_id") * 10 + 3).alias("seq"), F.col("pair_id").alias("id"), F.lit("approx_shortest_path").alias("type"), pair.alias("queries"), "acceptable_error_pct")
    sent = _fleet(t).select((F.col("id") * 10 + 4).alias("seq"), "id", F.lit("delivery").alias("type"), "orders", F.struct("num_drivers", "depot_node").alias("fleet"))
    places = t["knn_requests"].select("seq", "id", F.lit("knn").alias("type"), "poi", F.struct("lat", "lon").alias("query_point"), "k", "metric")
    changes = t["updates"].select("seq", "id", "type", "edge_id", F.struct(F.col("p_length").alias("length"), F.lit(None).cast("double").alias("average_time"), F.lit(None).cast("array<double>").alias("speed_profile"), F.col("p_road_type").alias("road_type")).alias("patch"))
    tens = [one.withColumn("seq", F.col("seq") * 10) for one in (roads, places, changes)]
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*tens, several, diverse, near, sent])
    found = plan.answer_events(t.pois(), t.profiled(), log)
    return found.select("seq", "id", "type", "error", "status", "possible", F.round("minimum", 4).alias("minimum"), F.array_join("path", ",").alias("path"), F.array_join("result", ",").alias("result"), F.to_json("paths").alias("paths"), F.to_json("distances").alias("distances"), F.to_json("assignments").alias("assignments"), F.round("metrics.total_delivery_time_s", 3).alias("total_delivery_time_s"), "edge_id", "removed", "done")


@query()
def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log of updates, path and place requests, and faulty events."""
    t = Tables(spark, sf_dir)
    roads = t["path_requests"].select("seq", "id", F.when(F.col("id") % 700 == 0, F.lit("drive")).otherwise(F.lit("shortest_path")).alias("type"), "source", "target", "mode", _limits().alias("constraints"))
    places = t["knn_requests"].select("seq", "id", F.lit("knn").alias("type"), "poi", F.struct("lat", "lon").alias("query_point"), F.when(F.col("id") % 4 > 0, F.col("k")).alias("k"), "metric")
    changes = t["updates"].select("seq", "id", "type", "edge_id", F.struct(F.col("p_length").alias("length"), F.lit(None).cast("double").alias("average_time"), F.lit(None).cast("array<double>").alias("speed_profile"), F.col("p_road_type").alias("road_type")).alias("patch"))
    log = roads.unionByName(places, allowMissingColumns=True).unionByName(changes, allowMissingColumns=True).withColumn("orders", F.lit(None).cast("array<struct<order_id:bigint,pickup:bigint,dropoff:bigint>>")).withColumn("fleet", F.lit(None).cast("struct<depot_node:bigint>"))
    found = plan.answer_events(t.pois(), t.profiled(), log)
    return found.select("seq", "id", "type", "error", "status", "possible", F.round("minimum", 4).alias("minimum"), F.array_join("path", ",").alias("path"), F.array_join("result", ",").alias("result"), "edge_id", "removed", "done")
