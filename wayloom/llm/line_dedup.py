"""Removal of lines that many documents share, by a sharded minimal perfect hash of their digests.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Each task
counts the distinct keys of its documents before they are shuffled, so a line of a third of all
documents is one row of a task. Keys found in enough documents are dealt into shards by their digest,
and each shard becomes a minimal perfect hash: levels of bits in which a key owns a position that no other
key of its level takes, numbered by the bits set before it. That number indexes arrays of
fingerprints (64 bits, so that a key outside the set passes with probability 2^-64), document counts and
largest ids. Documents probe the arrays: while all shards together stay below a bound they are
broadcast, and no document moves; beyond it the distinct keys of documents go to their shard, in units of bounded
size however hot a line is, and the answers return to the documents.

Defined cases. A null or empty text is one empty line. A row is a document, so repeated rows count
each, and all rows of the largest id keep a line. A null id is smaller than any other. Ids are
integers. Texts are taken whole, one at a time. ``n_lines``, ``n_dropped`` of the input are
replaced; other extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, batch_of, map_arrow, mix, scratch, sliced, texts

#: Keys of a shard at most on average, and keys that a task counts before it sends them on.
SHARD_KEYS, HELD_KEYS = 8192, 200_000

#: Bytes of all shards up to which they are broadcast, and probes of a unit beyond that.
BROADCAST_BYTES, UNIT_PROBES = 64 << 20, 1 << 18

#: Stands for a null id: below every id.
NO_ID = -(1 << 63)

_LEVEL = 0x9E3779B97F4A7C15


def _key(line: bytes, chars: int) -> bytes | None:
    """The key of a line (whose A-Z are in lower case already) of at least ``chars`` code points."""
    key = line.strip(SPACES)
    if len(key) < chars or (len(key) < 4 * chars and len(key.decode("utf-8", "replace")) < chars):
        return None
    return key


def line_keys(text: bytes, chars: int) -> list[bytes | None]:
    """16-byte digests of the keys of all lines, None for lines too short to count."""
    keys = (_key(line, chars) for line in text.lower().split(b"\n"))
    return [None if key is None else xxhash.xxh3_128_digest(key) for key in keys]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _ids(column: pa.Array) -> list[int]:
    return [NO_ID if i is None else i for i in column.to_pylist()]


def key_counts(docs: DataFrame, chars: int, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """h1, h2 (the key's digest), n (documents that hold it), top (the largest id of these)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            h1, h2 = _halves(list(held))
            n, top = np.array(list(held.values()), np.int64).reshape(-1, 2).T
            held.clear()
            return batch_of({"h1": h1, "h2": h2, "n": n, "top": top})

        for batch in sliced(batches):
            for own, data in zip(_ids(batch.column(0)), texts(batch.column(1))):
                for digest in set(line_keys(data, chars)):
                    if digest is None:
                        continue
                    entry = held.get(digest)
                    if entry is None:
                        held[digest] = [1, own]
                    else:
                        entry[0] += 1
                        entry[1] = max(entry[1], own)
                if len(held) >= HELD_KEYS:
                    yield out()
        if held:
            yield out()

    parts = docs.select(F.col(id_).cast("long"), text).mapInArrow(count, "h1 long, h2 long, n long, top long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def _level_hash(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    return mix(h1.view(np.uint64) ^ mix(h2.view(np.uint64) + np.uint64((level + 1) * _LEVEL % (1 << 64))))


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: bits of each level, all bits as words, and the number of each key."""
    left, sizes, words = np.arange(len(h1)), [], []
    place = np.zeros(len(h1), np.int64)
    base = 0
    while len(left):
        size = max(64, -(-2 * len(left) // 64) * 64)
        at = (_level_hash(h1[left], h2[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        own = alone[at]
        place[left[own]] = base + at[own]
        left, base = left[~own], base + size
        sizes.append(size)
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return sizes, bits, _rank(bits, _ranks(bits), place)


def _ranks(bits: np.ndarray) -> np.ndarray:
    """Bits set before each word."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])


def _rank(bits: np.ndarray, ranks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Bits set before each place."""
    if not len(place):
        return np.zeros(0, np.int64)
    below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
    return ranks[place >> 6] + np.bitwise_count(bits[place >> 6] & below)


_SHARDS = "shard int, n int, probes long, sizes array<int>, bits binary, prints binary, counts binary, tops binary"


def index(keys: DataFrame, shards: int) -> DataFrame:
    """One row for each shard that has keys: level sizes, bits, and the arrays that the perfect hash indexes."""

    def make(keys: pa.Table) -> pa.Table:
        h1, h2, n, top = (keys.column(c).to_numpy() for c in ("h1", "h2", "n", "top"))
        sizes, bits, at = build(h1, h2)
        prints, counts, tops = np.empty(len(at), np.int64), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        prints[at], counts[at], tops[at] = h1, n, top
        shard = int(h1[0].astype(np.uint64) % np.uint64(shards))
        made = {"shard": pa.array([shard], pa.int32()), "n": pa.array([len(at)], pa.int32()), "probes": pa.array([int(n.sum())], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int32()))}
        made |= {c: pa.array([x.tobytes()], pa.binary()) for c, x in (("bits", bits), ("prints", prints), ("counts", np.minimum(counts, 2**32 - 1).astype("<u4")), ("tops", tops))}
        return pa.table(made)

    return keys.withColumn("shard", _shard("h1", shards)).groupBy("shard").applyInArrow(make, _SHARDS)


def _shard(h1: str, shards: int):
    """h1, taken as unsigned, modulo the number of shards."""
    return F.expr(f"cast(pmod(pmod({h1}, {shards}L) + if({h1} < 0, {(1 << 64) % shards}L, 0L), {shards}L) as int)")


class Index:
    """Shards side by side, probed for many keys at once."""

    def __init__(self, rows: list, shards: int):
        deep = max((len(r["sizes"]) for r in rows), default=0)
        self.shards, self.sizes = shards, np.zeros((deep + 1, shards), np.int64)
        self.bases = np.zeros((deep + 1, shards), np.int64)
        bits, base = [], 0
        for r in rows:
            for level, size in enumerate(r["sizes"]):
                self.sizes[level, r["shard"]], self.bases[level, r["shard"]] = size, base
                base += size
            bits.append(np.frombuffer(r["bits"], "<u8"))
        whole = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in rows)])
        self.bits = np.concatenate([np.zeros(0, np.uint64), *bits])
        self.prints, self.counts, self.tops = whole("prints", "<i8"), whole("counts", "<u4"), whole("tops", "<i8")
        self.ranks = _ranks(self.bits)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each key in the arrays, -1 for keys outside the set.

        Shards lie in order of their rows, so bits set before a place count the keys of earlier shards too.
        """
        out = np.full(len(h1), -1, np.int64)
        shard = (h1.view(np.uint64) % np.uint64(self.shards)).astype(np.int64)
        left = np.arange(len(h1))
        for level in range(len(self.sizes)):
            size = self.sizes[level, shard[left]]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = (_level_hash(h1[left], h2[left], level) % size.astype(np.uint64)).astype(np.int64) + self.bases[level, shard[left]]
            set_ = (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[set_]] = _rank(self.bits, self.ranks, at[set_])
            left = left[~set_]
        known = np.flatnonzero(out >= 0)
        out[known[self.prints[out[known]] != h1[known]]] = -1
        return out

    def dropped(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a document of each id loses the lines of each key."""
        at = self.find(h1, h2)
        out = at >= 0
        out[out] = ids[out] < self.tops[at[out]]
        return out


def _kept(data: bytes, keys: list[bytes | None], gone: set[bytes]) -> tuple[int, bytes]:
    """Lines dropped, and the text of the others."""
    lines = data.split(b"\n")
    stay = [line for line, key in zip(lines, keys) if key is None or key not in gone]
    return len(lines) - len(stay), b"\n".join(stay)


def _columns(docs: DataFrame, id_: str, text: str) -> tuple[DataFrame, T.StructType, list[str]]:
    """``docs`` ready for Python, the schema of the result, and the columns handed through."""
    docs = docs.drop("n_lines", "n_dropped")
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return docs, schema, rest


def _out(batch: pa.RecordBatch, rest: list[str], text: str, lines: list[int], dropped: list[int], left: list[bytes]) -> pa.RecordBatch:
    kept = pa.array(left, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
    return batch_of({**{c: batch.column(c) for c in rest}, text: kept, "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})


def _by_broadcast(docs: DataFrame, shards: list, count: int, chars: int, id_: str, text: str) -> DataFrame:
    docs, schema, rest = _columns(docs, id_, text)
    sent = docs.sparkSession.sparkContext.broadcast(Index(shards, count))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = sent.value
        data, own = texts(batch.column(text)), _ids(batch.column(id_))
        keys = [line_keys(d, chars) for d in data]
        asked = [[k for k in set(ks) if k is not None] for ks in keys]
        flat = [k for ks in asked for k in ks]
        h1, h2 = _halves(flat)
        gone = found.dropped(h1, h2, np.repeat(np.array(own, np.int64), [len(ks) for ks in asked])).tolist()
        lines, dropped, left, at = [], [], [], 0
        for d, ks, mine in zip(data, keys, asked):
            n, kept = _kept(d, ks, {k for k, g in zip(mine, gone[at : at + len(mine)]) if g})
            at += len(mine)
            lines.append(len(ks))
            dropped.append(n)
            left.append(kept)
        yield _out(batch, rest, text, lines, dropped, left)

    return map_arrow(docs, each, schema)


def _by_shards(docs: DataFrame, made: DataFrame, count: int, others: int, chars: int, id_: str, text: str) -> DataFrame:
    """Probes go to the shards: a unit is a shard, or one of several shares of its documents.

    ``others``: probes of a shard to be expected besides those of its own keys.
    """
    docs, schema, rest = _columns(docs, id_, text)
    digest = lambda: F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, of, data in zip(batch.column("id").to_pylist(), batch.column("of").to_pylist(), texts(batch.column("text"))):
            h1, h2 = _halves([k for k in set(line_keys(data, chars)) if k is not None])
            if len(h1):
                yield batch_of({"id": pa.array([own] * len(h1), pa.int64()), "of": pa.array([of] * len(h1)), "h1": h1, "h2": h2})

    asked = map_arrow(docs.select(F.col(id_).cast("long").alias("id"), digest().alias("of"), F.col(text).alias("text")).dropDuplicates(["id", "of"]), ask, "id long, of string, h1 long, h2 long")
    share = F.ceil((F.col("probes") + others) / UNIT_PROBES).cast("int")
    units = made.select(F.col("shard").alias("_s"), share.alias("units"))
    probes = asked.withColumn("shard", _shard("h1", count)).join(units, F.col("shard") == F.col("_s")).drop("_s")
    probes = probes.withColumn("unit", F.pmod(F.xxhash64("id", "of"), F.col("units")).cast("int")).drop("units")
    copies = made.withColumn("unit", F.explode(F.sequence(F.lit(0), share - 1)))

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        rows = shard.to_pylist()
        h1, h2 = asked.column("h1").to_numpy(), asked.column("h2").to_numpy()
        found = Index(rows, count) if rows else None
        ids = np.array(_ids(asked.column("id")), np.int64)
        gone = found.dropped(h1, h2, ids) if found and len(h1) else np.zeros(len(h1), bool)
        return asked.filter(pa.array(gone)).select(["id", "of", "h1", "h2"])

    told = probes.groupBy("shard", "unit").cogroup(copies.groupBy("shard", "unit")).applyInArrow(answer, "id long, of string, h1 long, h2 long")
    gone = told.groupBy("id", "of").agg(F.collect_list(F.struct("h1", "h2")).alias("_gone")).select(F.col("id").alias("_id"), F.col("of").alias("_of2"), "_gone")
    met = docs.withColumn("_of", digest()).join(gone, F.col(id_).cast("long").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_of2")), "left").drop("_id", "_of", "_of2")

    def drop(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lines, dropped, left = [], [], []
        for data, gone in zip(texts(batch.column(text)), batch.column("_gone").to_pylist()):
            keys = line_keys(data, chars)
            n, kept = _kept(data, keys, {np.array([g["h1"], g["h2"]], "<i8").tobytes() for g in gone or ()})
            lines.append(len(keys))
            dropped.append(n)
            left.append(kept)
        yield _out(batch, rest, text, lines, dropped, left)

    return map_arrow(met, drop, schema)


def drop_lines(docs: DataFrame, least: int = 3, chars: int = 20, id_: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the lines that stay in ``text``, and n_lines (before dropping) and n_dropped.

    A key of at least ``chars`` code points that ``least`` documents or more hold loses
    all its lines except in the largest id among them; lines that stay are joined by a line feed.
    """
    spark = docs.sparkSession
    path = scratch(spark)
    seen = Observation()
    shared = key_counts(docs, chars, id_, text).observe(seen, F.sum("n").alias("probes")).filter(F.col("n") >= least)
    shared.write.parquet(f"{path}-keys")
    shared = spark.read.schema(shared.schema).parquet(f"{path}-keys")
    shards = max(1, -(-shared.count() // SHARD_KEYS))
    index(shared, shards).write.parquet(f"{path}-shards")
    made = spark.read.schema(_SHARDS).parquet(f"{path}-shards")
    size = made.agg(F.sum(F.octet_length("bits") + F.octet_length("prints") + F.octet_length("counts") + F.octet_length("tops"))).first()[0] or 0
    if size <= broadcast_bytes:
        return _by_broadcast(docs, made.collect(), shards, chars, id_, text)
    return _by_shards(docs, made, shards, (seen.get["probes"] or 0) // shards, chars, id_, text)
