"""Distances and travel times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean radius of the earth in metres, what stands for the distance
# to an unknown node, width of a time slot, least speed, and fallback speed.
EARTH_M = 6371000.0
UNKNOWN_M = 1e9
SLOT_WIDTH = 15.0
LEAST_SPEED = 0.0001
FALLBACK_SPEED = 13.8

#: Targets of a list that travels as one row.
LISTED = 4096


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; 1e9 if a coordinate is null."""
    up = F.sin(F.radians(lat2 - lat1) / 2)
    along = F.sin(F.radians(lon2 - lon1) / 2)
    h = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * along * along
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.lit(2 * EARTH_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h)), F.lit(UNKNOWN_M))


def deg2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in degrees."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def distances_to(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id, km: from every node to each of ``targets`` (target); infinite for an unknown target.

    Targets are counted and dealt by hash into lists of about ``LISTED``; every node meets each list once. One list
    is broadcast; several are joined with the nodes, which are spread over tasks within each list.
    """
    places = nodes.select(F.col("id").alias("target"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    wanted = targets.select("target").distinct().join(places, "target", "left")
    lists = max(-(-targets.select("target").distinct().count() // LISTED), 1)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    listed = wanted.groupBy(dealt("target", lists).alias("_k")).agg(F.collect_list(F.struct("target", "t_lat", "t_lon")).alias("all"))
    rows = nodes.select("id", "lat", "lon").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))))
    if lists == 1:
        met = rows.join(F.broadcast(listed), "_k")
    else:
        spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copies = listed.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        met = rows.withColumn("_s", dealt("id", spread)).join(copies.hint("shuffle_hash"), ["_k", "_s"])
    pairs = met.select("id", "lat", "lon", F.explode("all").alias("t"))
    km = F.when(F.col("t.t_lat").isNull(), F.lit(float("inf"))).otherwise(haversine_m(F.col("lat"), F.col("lon"), F.col("t.t_lat"), F.col("t.t_lon")) / 1000.0)
    return pairs.select(F.col("t.target").alias("target"), "id", km.alias("km"))


def profile_speeds(profile: Column) -> Column:
    """Speeds with the least speed as floor."""
    return F.transform(profile, lambda v: F.when(v <= LEAST_SPEED, F.lit(LEAST_SPEED)).otherwise(v))


def profile_cumsum(speeds: Column, slot_width: float = SLOT_WIDTH, block: int = 8) -> Column:
    """Metres covered before each slot begins, from clock 0; sums of blocks of slots first, then within each."""
    add = lambda a, v: a + v * F.lit(slot_width)
    n = F.size(speeds)
    spots = F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(block)).cast("int") - 1, F.lit(0)))
    blocks = F.transform(spots, lambda b: F.aggregate(F.slice(speeds, b * block + 1, F.lit(block)), F.lit(0.0), add))
    starts = F.aggregate(blocks, F.array(F.lit(0.0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    inside = lambda s, b: F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda j: F.aggregate(F.slice(speeds, b * block + 1, j), s, add))
    return F.slice(F.flatten(F.transform(starts, inside)), F.lit(1), n)


def arrival_time(t: Column, length: Column, speeds: Column, cum: Column, slot_width: float = SLOT_WIDTH) -> Column:
    """Clock on arrival after ``length`` metres begun at ``t``, where speed changes with the slot.

    ``cum`` is ``profile_cumsum(speeds)``: the way driven by a clock is a
    piecewise linear function, so the arrival is its inverse at the start's
    value plus the length. The last slot's speed goes on for ever.
    """
    last = F.size(cum) - 1
    k0 = F.least(F.floor(t / slot_width).cast("int"), last)
    target = F.get(cum, k0) + F.get(speeds, k0) * (t - k0 * F.lit(slot_width)) + length
    k1 = F.size(F.filter(cum, lambda c: c <= target)) - 1
    return k1 * F.lit(slot_width) + (target - F.get(cum, k1)) / F.get(speeds, k1)


def edge_time(avg_time: Column, length: Column, fallback: float = FALLBACK_SPEED) -> Column:
    """Mean time of an edge; length over the fallback speed where none is known."""
    return F.when(avg_time > 0, avg_time).otherwise(length / F.lit(fallback))
