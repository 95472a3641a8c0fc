"""Jump consistent hashing of rows to shards, with DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# The multiplier of the published jump-hash generator, 2^64, 2^33, 2^31.
MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
TWO_33 = 8589934592
TWO_31 = 2147483648


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit ``key`` among ``shards``; null counts as key 0.

    A row starts at shard 0 and jumps on to later shards as a generator seeded
    with its key says; the last one below ``shards`` is the row's. Each jump goes
    at least one shard on, so ``shards`` steps are enough. The generator is
    reckoned in decimals, which hold the whole product of two 64-bit numbers.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    whole = "decimal(20,0)"
    start = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")).cast(whole)
    seed = F.when(start < 0, start + F.lit(Decimal(TWO_64)).cast(whole)).otherwise(start).cast(whole)
    one = F.struct(seed.alias("seed"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"))

    def step(s: Column, _: Column) -> Column:
        product = s["seed"] * F.lit(Decimal(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
        seed = (product % F.lit(Decimal(TWO_64)).cast(whole)).cast(whole)
        high = F.floor(seed / F.lit(Decimal(TWO_33)).cast(whole)).cast("double") + F.lit(1.0)
        jumped = F.floor((s["next"] + F.lit(1)).cast("double") * (F.lit(float(TWO_31)) / high)).cast("bigint")
        moved = F.struct(seed.alias("seed"), s["next"].alias("at"), jumped.alias("next"))
        return F.when(s["next"] < F.lit(shards), moved).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), one, step, lambda s: s["at"])
    return end.cast("int")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, rows_per_bucket: int | None = None) -> DataFrame:
    """Put every row of ``df`` into a shard by its ``key`` and number the rows of each shard.

    Returns the key, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``,
    ``shard``, ``slot`` (gapless from 0 in the shard) and ``grown_shard`` (the
    shard if there were one more). Key and number of shards alone decide; rows
    that move when a shard is appended all move into it. A null text has size 1
    and the checksum of the empty text; a null key counts as 0; keys that are no
    whole numbers of at most 64 bits count by their hash. Repeated rows
    keep a slot each; an empty table gives an empty result. Other columns of
    ``df`` are not read.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.col(f"`{key}`")
    if not isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        own = F.when(own.isNotNull(), F.xxhash64(own))
    rows = df.select(
        F.col(f"`{key}`").alias("doc_id"),
        (F.octet_length(body).cast("long") + F.lit(1).cast("long")).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_shard(own, shards).alias("shard"),
        jump_shard(own, shards + 1).alias("grown_shard"),
    )
    out = common.gapless(rows, "shard", ["doc_id", "size", "text_crc32"], ["doc_id"], rows_per_bucket)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
