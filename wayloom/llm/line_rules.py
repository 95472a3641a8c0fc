"""Quality rules: per-text measures, and lines that many documents of one host share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def line_key(line: bytes) -> int:
    """64-bit hash of a normalised line: A-Z as a-z, runs of white space as one space, digits as 0."""
    body = b" ".join(line.lower().split()).translate(_DIGITS)
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


_DIGITS = bytes(0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more."""
    if len(hashes) <= width:
        return 0
    windows = common.shingle_hashes(hashes, width)
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.zeros(len(hashes) + 1, np.int32)
    hit = np.flatnonzero(counts[back] > 1)
    np.add.at(again, hit, 1)
    np.add.at(again, hit + width, -1)
    return int((np.cumsum(again) > 0).sum())


def measures(text: bytes) -> dict:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each distinct line."""
    raw = np.frombuffer(text, np.uint8)
    hashes, begin, end = common.word_hashes(text)
    chars = int(((raw & 0xC0) != 0x80).sum()) - int(common._IS_SPACE[raw].sum()) if len(raw) else 0
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    dup = 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        key = line_key(line)
        lines[key] = lines.get(key, 0) + n
    return {
        "n_words": len(hashes),
        "word_chars": chars,
        "n_symbols": int(_SYMBOLS[raw].sum()) if len(raw) else 0,
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(hashes),
        "text_key": int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True),
        "lines": [{"key": k, "words": n} for k, n in lines.items()],
    }


_SCHEMA = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_key long, lines array<struct<key:long,words:long>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key")]
    + [("lines", pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int64())])))]
)


def line_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    min_docs: int = 5, share: float = 0.05, min_left: float = 0.3, min_words: int = 50, max_repeat: float = 0.5, broadcast_rows: int = 200_000,
) -> DataFrame:
    """Measure every text, take out lines that too many documents of its host share, and judge what is left.

    A normalised line is over the limit on a host if more than ``min_docs`` and
    more than ``share`` of the host's documents have it. A document counts by its
    id and text: repeated rows count once, copies under ids of their own each. A
    document is kept if it has at least ``min_words`` words, at most ``max_repeat``
    of them in repeated 3-word windows, and is not depleted: at least ``min_words``
    and at least ``min_left`` of its words are outside lines over the limit.

    Null text: no words, not kept. Documents without a host share one. Result
    columns: doc_id, host, the measures, n_removed_words, base_failed, kept. An
    empty table gives an empty result; other columns are not read.
    """
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\0")).alias("host"))

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [{"doc_id": d, "host": h} | measures(t) for d, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("host").to_pylist(), common.texts(batch.column("text")))]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    measured = common.cut(common.map_arrow(source, measure, _SCHEMA)).withColumn("row", F.monotonically_increasing_id())
    # a row number for each document, so that its lines are told apart without its text's key
    once = measured.groupBy("host", "doc_id", "text_key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"))
    repeats = once.filter("rows > 1").select("host", "doc_id", "text_key", F.col("row").alias("first"))
    per_host = once.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    told = measured.join(repeats.withColumnsRenamed({"host": "r_host", "doc_id": "r_id", "text_key": "r_key"}), F.col("host").eqNullSafe(F.col("r_host")) & F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")), "left")
    lines = told.filter(F.col("first").isNull() | (F.col("first") == F.col("row"))).select("host", F.explode("lines.key").alias("key"))
    counted = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    over = common.cut(counted.join(per_host, "host").filter(F.col("n") > F.col("host_docs") * F.lit(share)).select(F.col("host").alias("o_host"), F.col("key").alias("o_key")))
    own = measured.select("row", "host", F.explode("lines").alias("line"))
    if over.count() <= broadcast_rows:
        over = F.broadcast(over)
    hit = own.join(over, (own["host"] == over["o_host"]) & (own["line.key"] == over["o_key"]), "left_semi")
    removed = hit.groupBy("row").agg(F.sum("line.words").alias("n_removed_words"))
    judged = measured.drop("lines", "text_key").join(removed, "row", "left").drop("row")
    n = F.col("n_words")
    failed = (n < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * n)
    gone = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    left = n - gone
    return judged.withColumns({"n_removed_words": gone, "base_failed": failed, "kept": ~failed & (left >= min_words) & (left >= F.lit(min_left) * n)}).withColumn("host", F.nullif("host", F.lit("\0")))
