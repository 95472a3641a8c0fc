"""Helpers that the operators share: tables, lineage cuts, Arrow batches, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words: space, and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"

#: Text bytes that one step of a vectorised pass holds at once (longer texts alone).
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    That folder is ``spark.checkpoint.dir``; only where it is unset and all of
    Spark is this one process (tests) a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-wayloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/wayloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` now and go on from its rows, written to the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same by a Parquet table, for small tables of a loop: the next plan knows nothing of how they came about.

    A checkpoint hands its plan's constraints on, which grow from round to round.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``most`` bytes.

    Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch; the slices
    bound what Python makes of it.
    """
    for batch in batches:
        n = max(1, min(rows, batch.num_rows * most // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` of a function on one slice of a batch (``sliced``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield from f(batch)

    return df.mapInArrow(run, schema)


def batch_of(columns: dict[str, object], types: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    types = types or {}
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, types.get(k)) for k, c in columns.items()], names=list(columns)
    )


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    return column.cast(pa.large_binary()).to_pylist()


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fold of a row. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_POWERS = np.ones(1, np.uint64)


def _geometric(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = _geometric(_BASE, n)
    return _POWERS[:n]


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_INVERSES = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        _INVERSES = _geometric(_INVERSE, n)
    return _INVERSES[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space words of ``data``, and where each begins and ends."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    edge = np.diff(np.concatenate([[False], ~_IS_SPACE[raw], [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(len(raw)), dtype=np.uint64, out=sums[1:])
    h = (sums[end] - sums[begin]) * _inverses(len(raw))[begin] + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(h), begin, end


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all ``width`` words in a row; of the whole sequence if it is shorter."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * _BASE + words[k : k + n]
    return mix(h)


def gapless(df: DataFrame, group: str, order: list[str], deal: list[str], rows_per_bucket: int | None = None, name: str = "slot") -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps, built-in functions only.

    Rows of a group are dealt into buckets by a hash of ``deal``, so that no
    window holds a whole group; a small table of bucket sizes gives each bucket
    its first number. A group of n rows has about the square root of n buckets
    (or n / ``rows_per_bucket``), so that both its buckets and the list of their
    sizes stay small. Within a bucket the order is that of ``order``; rows equal
    in all of it may take each other's place. The sizes need the columns of
    ``deal`` and the group only, so wide columns are read once. There may be few groups only.
    """
    n = F.count(F.lit(1))
    wanted = F.ceil(F.sqrt(n)) if rows_per_bucket is None else F.ceil(n / F.lit(rows_per_bucket))
    groups = df.groupBy(group).agg(wanted.cast("long").alias("_buckets")).withColumnRenamed(group, "_group")
    dealt = df.join(F.broadcast(groups), df[group].eqNullSafe(F.col("_group"))).drop("_group")
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64(*deal), F.col("_buckets"))).drop("_buckets")
    sizes = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = "sum(_n) over (partition by {g} order by _bucket rows between unbounded preceding and current row) - _n"
    begins = sizes.selectExpr(f"{group} as _g", "_bucket as _b", f"{first.format(g=group)} as _first")
    rank = f"row_number() over (partition by {group}, _bucket order by {', '.join(order)}) - 1"
    ranked = dealt.withColumn("_rank", F.expr(rank))
    joined = ranked.join(begins, ranked[group].eqNullSafe(begins["_g"]) & (ranked["_bucket"] == begins["_b"]))
    return joined.withColumn(name, (F.col("_rank") + F.col("_first")).cast("long")).drop("_bucket", "_rank", "_g", "_b", "_first")


def quoted(names: Iterable[str]) -> list[str]:
    return ["`" + re.sub("`", "``", n) + "`" for n in names]
