"""Wu-Manber search of benchmark passages in documents, with words as letters."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes below 0x80 that are no digit or small letter, to spaces (after A-Z went to a-z).
_SEPARATORS = bytes(b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of digits, letters a-z and anything beyond ASCII; A-Z count as a-z."""
    return text.lower().translate(_SEPARATORS).split()


class Patterns:
    """Wu-Manber tables over word sequences of one length ``m``.

    ``shift`` has, for each block of ``block`` words that occurs in a pattern,
    how far the search may move on when a window ends in that block; a block
    that occurs nowhere allows ``m - block + 1`` words. Where the shift is 0 the
    block ends some patterns: ``bucket`` has them, and the whole window is
    compared with each.
    """

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[str]], block: int = 3):
        self.m, self.block = m, min(block, m)
        self.most = m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[list[bytes], list[str]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                key = b" ".join(pattern[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.most), m - end)
            self.bucket[key].append((list(pattern), items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Each position where a pattern begins, with the items that have it."""
        m, block, most, shift, n = self.m, self.block, self.most, self.shift, len(text)
        end = m
        while end <= n:
            move = shift.get(b" ".join(text[end - block : end]), most)
            if move:
                end += move
                continue
            for pattern, items in self.bucket[b" ".join(text[end - block : end])]:
                if text[end - m : end] == pattern:
                    yield end - m, items
            end += 1


def compile_patterns(items: list[tuple[object, str | None]], window: int) -> list[Patterns]:
    """Tables for all windows of the items, one set for each pattern length; a null item id counts as an empty one."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(dict)
    for item, text in items:
        w = words((text or "").encode())
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            own = by_length[m].setdefault(tuple(w[i : i + m]), [])
            name = "" if item is None else str(item)
            if not own or own[-1] != name:
                own.append(name)
    return [Patterns(m, p) for m, p in sorted(by_length.items())]


def hit_words(text: list[bytes], tables: list[Patterns]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged ranges of words inside occurrences, and the items that occur."""
    spans: list[tuple[int, int]] = []
    found: set[str] = set()
    for table in tables:
        for begin, items in table.search(text):
            spans.append((begin, begin + table.m))
            found.update(items)
    spans.sort()
    merged: list[tuple[int, int]] = []
    for begin, end in spans:
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((begin, end))
    return merged, found


def _blocks(items: DataFrame, block_items: int, block_bytes: int = 16 << 20) -> list[DataFrame]:
    """The items (i, t) in blocks of at most about ``block_items`` rows and ``block_bytes`` of text, by hash."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-(size["b"] or 0) // block_bytes))
    return [items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) for k in range(blocks)]


_HITS = "doc_id long, n_words long, spans array<struct<begin:int,end:int>>, items array<string>"
_HITS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))]
)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = 20_000) -> DataFrame:
    """Per document: its words, merged word ranges that a benchmark window covers, and the items found.

    The items go to the executors in blocks (``_blocks``), each
    block with all documents once, so that no broadcast grows with the benchmark;
    with one block there is no shuffle. A document or item that is null or has no
    word has no window; an item whose id is null is listed under an empty id;
    repeated rows each get a row; an empty benchmark hits nothing; other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    shares = _blocks(items, block_items)
    blocks = len(shares)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if blocks > 1:
        source = source.withColumn("_row", F.monotonically_increasing_id())
        source = common.cut(source)
    parts = []
    for own in shares:
        tables = spark.sparkContext.broadcast(compile_patterns([(r["i"], r["t"]) for r in own.toLocalIterator()], window))

        def search(batch: pa.RecordBatch, tables=tables) -> Iterator[pa.RecordBatch]:
            out = []
            for key, body in zip(batch.column("doc_id").to_pylist(), common.texts(batch.column("text"))):
                w = words(body)
                spans, found = hit_words(w, tables.value)
                out.append({"doc_id": key, "n_words": len(w), "spans": [{"begin": a, "end": b} for a, b in spans], "items": sorted(found)})
            got = pa.RecordBatch.from_pylist(out, schema=_HITS_ARROW)
            if "_row" in batch.schema.names:
                got = pa.RecordBatch.from_arrays([*got.columns, batch.column("_row")], names=[*got.schema.names, "_row"])
            yield got

        parts.append(common.map_arrow(source, search, _HITS + (", _row long" if blocks > 1 else "")))
    if blocks == 1:
        return parts[0]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    spans = F.flatten(F.collect_list("spans"))
    merged = hits.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.array().cast("array<struct<begin:int,end:int>>")
    span = lambda a, b: F.struct(a.alias("begin"), b.alias("end"))

    def join(done, s):
        last = F.element_at(done, -1)
        touching = (F.size(done) > 0) & (s["begin"] <= F.get(done, F.size(done) - 1)["end"])
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(span(last["begin"], F.greatest(last["end"], s["end"]))))
        return F.when(touching, grown).otherwise(F.concat(done, F.array(span(s["begin"], s["end"]))))

    return merged.select("doc_id", "n_words", F.aggregate("spans", empty, join).alias("spans"), "items")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: n_words, n_hit (words in occurrences), n_items, items_sha256, contaminated."""
    found = occurrences(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"]).cast("long"))
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = 20_000) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns and no shuffle.

    Each block of items is one filter; the blocks follow one another on what is
    left. Documents without text stay, repeated rows stay repeated, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    at = docs.columns.index(text)
    for own in _blocks(items, block_items):
        tables = spark.sparkContext.broadcast(compile_patterns([(r["i"], r["t"]) for r in own.toLocalIterator()], window))

        def clean(batch: pa.RecordBatch, tables=tables) -> Iterator[pa.RecordBatch]:
            keep = [not any(True for t in tables.value for _ in t.search(w)) for w in map(words, common.texts(batch.column(at)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

        docs = common.map_arrow(docs, clean, docs.schema)
    return docs
