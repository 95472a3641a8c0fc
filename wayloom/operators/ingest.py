"""Map data to road graph: ways and places of OpenStreetMap to edges and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import graph

# Beginnings of the highway classes kept, road types of classes, speeds in m/s.
HIGHWAYS = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "service", "footway", "path", "cycleway"]
ROAD_TYPES = {"motorway": "expressway", "trunk": "expressway", "primary": "primary", "secondary": "secondary", "tertiary": "tertiary"}
SPEEDS = {"expressway": 27.78, "primary": 16.67, "secondary": 13.89, "tertiary": 11.11, "local": 8.33}
ONE_WAY = ("yes", "true", "1")

#: Steps of ways that a task sorts, about, and rows of a range that is numbered.
TASK_ROWS = 250_000


def tasks_of(ways: DataFrame) -> int:
    """How many tasks the steps of ``ways`` are dealt over: a row of a small file may become many, so bytes do not tell."""
    rows = ways.agg(F.sum(F.size("nodes"))).first()[0] or 0
    return max(int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def filter_ways(ways: DataFrame) -> DataFrame:
    """Ways whose highway tag begins with one of the classes kept, so that links count."""
    return ways.filter(F.col("tags")["highway"].rlike("^(" + "|".join(HIGHWAYS) + ")"))


def road_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that lie on a way."""
    return nodes.join(ways.select(F.explode("nodes").alias("id")).distinct(), "id", "left_semi")


def densify_ids(nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """``nodes`` with ``new_id``: 0, 1, 2 ... in the order of id.

    Ids are sorted over ranges; the sizes of the ranges, one row each, give each
    range its first number, so no window holds all rows.
    """
    spark = nodes.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    ranged = graph.cut(nodes.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("_p", F.shiftright(at, 33)).withColumn("_r", at.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).selectExpr("_p", "sum(_n) over (order by _p) - _n as _first")
    return ranged.join(F.broadcast(sizes), "_p").withColumn("new_id", (F.col("_first") + F.col("_r")).cast("long")).drop("_p", "_r", "_first")


def road_type(highway: Column) -> Column:
    """Road type of a highway class; a class that is not listed is local."""
    return F.coalesce(F.try_element_at(_map(ROAD_TYPES), highway), F.lit("local"))


def oneway_flag(tag: Column) -> Column:
    return F.coalesce(tag, F.lit("no")).isin(*ONE_WAY)


def way_segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, pos, u, v, coordinates, highway, oneway of each two neighbouring nodes of a way; unknown ends drop."""
    n = F.greatest(F.size("nodes") - 1, F.lit(0))
    pair = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    flat = ways.select(F.col("id").alias("way_id"), F.col("tags")["highway"].alias("highway"), F.col("tags")["oneway"].alias("oneway"), F.posexplode(F.zip_with(F.slice("nodes", F.lit(1), n), F.slice("nodes", F.lit(2), n), pair)).alias("pos", "s"))
    flat = flat.select("way_id", "pos", "s.u", "s.v", "highway", oneway_flag(F.col("oneway")).alias("oneway"))
    end = lambda k: nodes.select(F.col("id").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    return flat.join(end("u"), "u").join(end("v"), "v")


def segment_lengths(segments: DataFrame, min_m: float = 0.1) -> DataFrame:
    """Segments with their length in metres, without those shorter than ``min_m``."""
    return segments.withColumn("length", geo.haversine_m(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))).filter(F.col("length") >= min_m)


def average_time(length: Column, kind: Column) -> Column:
    """Seconds over a segment at its road type's speed, to the millisecond."""
    return F.round(length / F.coalesce(F.try_element_at(_map(SPEEDS), kind), F.lit(SPEEDS["local"])), 3)


def directed_records(segments: DataFrame) -> DataFrame:
    """Each segment forward, and backward too if two-way, with ``dir`` 0 and 1."""
    ahead, back = F.struct(F.col("u").alias("u"), F.col("v").alias("v"), F.lit(0).alias("dir")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1).alias("dir"))
    ways = F.when(F.col("oneway"), F.array(ahead)).otherwise(F.array(ahead, back))
    return segments.withColumn("_w", F.explode(ways)).drop("u", "v").select("*", "_w.u", "_w.v", "_w.dir").drop("_w")


def dedup_first(records: DataFrame) -> DataFrame:
    """Of the records of one (u, v), the first by way, position and direction; records dealt by u and v stay where they are."""
    rest = [c for c in records.columns if c not in ("u", "v")]
    first = F.min_by(F.struct(*rest), F.struct("way_id", "pos", "dir"))
    return records.groupBy("u", "v").agg(first.alias("_r")).select("u", "v", "_r.*")


def speed_profile(kind: Column, key: Column, slots: int = 96) -> Column:
    """Speeds of the day's slots, within 20 % of the road type's speed, set by a hash of key and slot."""
    base = F.coalesce(F.try_element_at(_map(SPEEDS), kind), F.lit(SPEEDS["local"]))
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.round(base * (F.lit(0.8) + F.pmod(F.xxhash64(key, s), F.lit(4001)) / 10000.0), 4))


def build_graph(osm_nodes: DataFrame, osm_ways: DataFrame, min_m: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon, pois, osm_id) and edges of a road graph from saved map data."""
    ways = filter_ways(osm_ways)
    tasks = tasks_of(ways)
    ways = ways.repartition(tasks, "id")
    placed = graph.cut(densify_ids(road_nodes(ways, osm_nodes.dropDuplicates(["id"])), tasks))
    segments = segment_lengths(way_segments(ways, placed.select("id", "lat", "lon")), min_m)
    records = dedup_first(directed_records(segments.withColumn("road_type", road_type(F.col("highway")))).repartition(tasks, "u", "v"))
    new = lambda k: placed.select(F.col("id").alias(k), F.col("new_id").alias(f"n_{k}"))
    joined = records.join(new("u"), "u").join(new("v"), "v")
    numbered = densify_ids(joined.withColumn("id", F.struct("n_u", "n_v")), tasks).drop("id")
    rounded = F.round("length", 3)
    edges = numbered.select(
        F.col("new_id").alias("id"), F.col("n_u").alias("u"), F.col("n_v").alias("v"), rounded.alias("length"),
        average_time(F.col("length"), F.col("road_type")).alias("avg_time"), speed_profile(F.col("road_type"), F.col("new_id")).alias("speed_profile"),
        "oneway", "road_type", F.lit(True).alias("active"),
    )
    pois = F.col("pois") if "pois" in osm_nodes.columns else F.array().cast("array<string>")
    nodes = placed.select(F.col("new_id").alias("id"), "lat", "lon", pois.alias("pois"), F.col("id").alias("osm_id"))
    return nodes, edges
