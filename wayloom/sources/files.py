"""Graph, event, map-data and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents

NODE = "struct<id:bigint,lat:double,lon:double,pois:array<string>>"
EDGE = "struct<id:bigint,u:bigint,v:bigint,length:double,avg_time:double,average_time:double,speed_profile:array<double>,oneway:boolean,road_type:string,active:boolean>"

PATCH = "struct<length:double,average_time:double,speed_profile:array<double>,road_type:string>"
EVENT_FIELDS = (
    "id:bigint,type:string,source:bigint,target:bigint,mode:string,"
    "constraints:struct<forbidden_nodes:array<bigint>,forbidden_road_types:array<string>>,"
    "poi:string,query_point:struct<lat:double,lon:double>,k:int,metric:string,"
    f"edge_id:bigint,patch:{PATCH},overlap_threshold:double,"
    "queries:array<struct<source:bigint,target:bigint>>,time_budget_ms:double,acceptable_error_pct:double,"
    "orders:array<struct<order_id:bigint,pickup:bigint,dropoff:bigint>>,goal:string,"
    "fleet:struct<num_delievery_guys:int,num_delivery_guys:int,depot_node:bigint>"
)
EVENT = f"struct<{EVENT_FIELDS}>"
OSM = "struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document (JSON), or of ``nodes`` and ``edges`` folders of Parquet.

    Edges keep ``pos``, their place in the document, which many tasks read (``documents.elements``).
    """
    if path.rstrip("/").endswith(".json"):
        found = documents.elements(spark, path)
        edges = documents.members(found, "edges", EDGE).select("e.*", F.col("pos").cast("int").alias("pos"))
        return documents.members(found, "nodes", NODE).select("e.*"), edges
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as Parquet, for ``read_graph``."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events in order: seq (their place), meta_id, and one column per field, null where an event has none."""
    found = documents.elements(spark, path)
    meta = documents.members(found, "meta", "struct<id:string>").select("path", F.col("e.id").alias("meta_id"))
    return documents.members(found, "events", EVENT).join(meta, "path", "left").select(F.col("pos").alias("seq"), "meta_id", "e.*")


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon) and ways (id, nodes, tags) of a saved map-data file."""
    e = documents.members(documents.elements(spark, path), "elements", OSM).select("e.*")
    return e.filter("type = 'node'").select("id", "lat", "lon"), e.filter("type = 'way'").select("id", "nodes", "tags")


def write_results(answers: DataFrame, path: str, fmt: str = "json", meta_id: str | None = None) -> None:
    """Answers in the order of seq: ``parquet``, ``json`` lines, or one ``document`` {meta, results}.

    Fields that do not belong to an answer are left out of JSON. A document is
    one value and therefore one row; use it for results of that size.
    """
    ordered = answers.orderBy("seq")
    if fmt == "parquet":
        ordered.write.mode("overwrite").parquet(path)
    elif fmt == "json":
        ordered.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    elif fmt == "document":
        body = F.struct(*[c for c in answers.columns if c != "seq"])
        one = answers.groupBy().agg(F.array_sort(F.collect_list(F.struct("seq", body.alias("r")))).alias("a"))
        one.select(F.struct(F.lit(meta_id).alias("id")).alias("meta"), F.transform("a", lambda x: x["r"]).alias("results")).write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
