"""The road graph: cleaning of nodes and edges, adjacency, endpoint checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 250_000

EDGE_DEFAULTS = {"id": "-1L", "u": "-1L", "v": "-1L", "length": "0.0D", "oneway": "true", "road_type": "''", "active": "true"}


def shared_dir(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; a temporary folder only where that is unset and all of Spark is this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-wayloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"


def cut(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Run ``df`` now and go on from its rows, written to the shared folder; ``old`` is of no more use.

    A written table also gives the next plan true sizes, where estimates would
    grow from round to round.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wayloom_path = path
    if old is not None and (stale := getattr(old, "_wayloom_path", None)):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stale)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return out


def together(parts: list[DataFrame]) -> DataFrame:
    """The rows of several results of ``cut`` of one schema, as one scan."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(p._wayloom_path for p in parts))


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Edges with every column present and defaults for nulls; either name of the mean time is read."""
    have = set(edges.columns)
    times = [F.col(c).cast("double") for c in ("avg_time", "average_time") if c in have]
    out = edges
    for name, default in EDGE_DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.expr(default)) if name in have else F.expr(default))
    out = out.withColumn("avg_time", F.coalesce(*times, F.lit(0.0))).drop("average_time")
    none = F.array().cast("array<double>")
    return out.withColumn("speed_profile", F.coalesce(F.col("speed_profile"), none) if "speed_profile" in have else none)


def fill_speed_profile(edges: DataFrame, slots: int = 96, fallback: float = 10.0) -> DataFrame:
    """An empty profile becomes ``slots`` times length / mean time, or the fallback speed without a time."""
    speed = F.when(F.col("avg_time") > 0, F.col("length") / F.col("avg_time")).otherwise(F.lit(fallback))
    return edges.withColumn("speed_profile", F.when(F.coalesce(F.size("speed_profile"), F.lit(0)) <= 0, F.array_repeat(speed, slots)).otherwise(F.col("speed_profile")))


def profile_ids(edges: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edges`` and ``patches`` with numbers in place of speed_profile and p_speed_profile, and profile, speed_profile: each distinct list once."""
    every = edges.select("speed_profile").union(patches.select("p_speed_profile")).filter("speed_profile is not null").distinct()
    lists = cut(every.withColumn("profile", F.monotonically_increasing_id()))
    numbered = lambda df, c: df.join(lists.select(F.col("speed_profile").alias(c), F.col("profile").alias("_id")), c).drop(c).withColumnRenamed("_id", c)
    bare = lambda df, c: df.filter(F.col(c).isNull()).withColumn(c, F.lit(None).cast("long"))
    return *(numbered(df, c).unionByName(bare(df, c)) for df, c in ((edges, "speed_profile"), (patches, "p_speed_profile"))), lists


def clean_pois(nodes: DataFrame) -> DataFrame:
    """Points of interest without blanks and repeats, in order of name; null is none."""
    pois = F.coalesce(F.col("pois"), F.array().cast("array<string>"))
    return nodes.withColumn("pois", F.array_sort(F.array_distinct(F.filter(pois, lambda p: p.isNotNull() & (p != " ")))))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """Directed edges (edge_id, src, dst and the edge's other columns): each edge u to v, and v to u if two-way.

    Inactive edges are left out. ``reverse`` swaps src and dst of all.
    """
    more = [c for c in edges.columns if c not in ("id", "u", "v", "oneway", "active", "edge_id", "src", "dst")]
    live = edges.filter("active") if "active" in edges.columns else edges
    a, b = ("v", "u") if reverse else ("u", "v")
    ways = F.when(F.col("oneway"), F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")))).otherwise(
        F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))
    )
    out = live.select(F.col("id").alias("edge_id"), F.explode(ways).alias("_w"), *more)
    return out.select("edge_id", "_w.src", "_w.dst", *more)


def collapse(adj: DataFrame, weight: str = "length") -> DataFrame:
    """One directed edge for each (src, dst): the cheapest, then the one of the smallest id."""
    best = adj.groupBy("src", "dst").agg(F.min(F.struct(F.col(weight), F.col("edge_id"))).alias("_b"))
    return best.select("src", "dst", f"_b.{weight}", "_b.edge_id")


def first_seen(adj: DataFrame) -> DataFrame:
    """(src, dst) to the edge that came first in the input: by ``pos`` if the edges carry it, then by id."""
    order = F.struct("pos", "edge_id") if "pos" in adj.columns else F.col("edge_id")
    return adj.groupBy("src", "dst").agg(F.min_by("edge_id", order).alias("edge_id"))


def check_endpoints(searches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``searches`` with ``valid``: source and (if given) target are nodes and not forbidden."""
    ids = nodes.select(F.col("id").alias("_id"))
    have = set(searches.columns)
    out = searches.join(ids.withColumnRenamed("_id", "_s"), F.col("source") == F.col("_s"), "left")
    ok = F.col("_s").isNotNull()
    if "target" in have:
        out = out.join(ids.withColumnRenamed("_id", "_t"), F.col("target") == F.col("_t"), "left")
        ok = ok & (F.col("_t").isNotNull() | F.col("target").isNull())
    if "forbidden_nodes" in have:
        for end in ("source", "target") if "target" in have else ("source",):
            ok = ok & ~F.coalesce(F.array_contains("forbidden_nodes", F.col(end)), F.lit(False))
    return out.withColumn("valid", ok).drop("_s", "_t")


def ends(adj: DataFrame) -> DataFrame:
    """id: the nodes that edges touch."""
    return adj.select(F.col("src").alias("id")).union(adj.select("dst")).distinct()


def degree(adj: DataFrame) -> DataFrame:
    """src, out_degree."""
    return adj.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
