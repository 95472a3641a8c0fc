"""Packing of token sequences into windows by non-negative least squares over length combinations."""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Id that ends every document.
END_ID = 1


#: A full stop or comma that ends a part after a letter is a token run of its own.
_CLOSING = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([.,])(?=[ \n]|\Z)")

#: Stands between parts that are encoded at once; parts that hold it are encoded alone.
_BETWEEN = "<|endoftext|>"


def splits_words(settings: dict) -> bool:
    """Whether a tokenizer's settings lower-case texts, treat white space as a border and split runs of letters off."""
    said = json.dumps(settings.get("normalizer") or {}) + json.dumps(settings.get("pre_tokenizer") or {})
    return '"Lowercase"' in said and "\\\\p{L}" in said and '"Removed"' in said


class Encoder:
    """Ids of whole texts by a lower-case tokenizer to which white space is nothing but a border.

    Texts are split at spaces, line breaks and before closing stops and commas,
    A-Z taken as a-z; each distinct part is then encoded once and remembered, at
    most ``most`` parts at a time. That leaves the ids as they are for a
    tokenizer whose file says that it lower-cases, drops white space and splits
    letters from other signs; for any other, whole texts are encoded.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool, self.most = Tokenizer.from_file(path), most
        self.between = self.tool.token_to_id(_BETWEEN)
        self.parted = splits_words(json.loads(self.tool.to_str())) and self.between is not None
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, each one run of letters, and how many each has: the tokenizer numbers such runs itself."""
        got = self.tool.encode(" ".join(parts), add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(parts))

    def _marked(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of any kind, with a special token between them."""
        ids = np.array(self.tool.encode(_BETWEEN.join(parts), add_special_tokens=False).ids, np.uint32)
        at = ids == self.between
        return ids[~at], np.diff(np.concatenate([[-1], np.flatnonzero(at), [len(ids)]])) - 1

    def _learn(self, parts: list[str]) -> None:
        kinds: tuple[list[str], ...] = ([], [], [])
        for p in parts:
            kinds[0 if p.isalpha() and (p.isascii() or (max(p) < "\u0250" and "\u0130" not in p)) else 1 if "<|" not in p else 2].append(p)
        made = [f(own) for f, own in ((self._together, kinds[0]), (self._marked, kinds[1])) if own]
        for p in kinds[2]:
            alone = np.array(self.tool.encode(p, add_special_tokens=False).ids, np.uint32)
            made.append((alone, np.array([len(alone)])))
        ids, sizes = (np.concatenate(x) for x in zip(*made))
        k, n = len(self.index), len(sizes)
        while k + n > len(self.begin):
            self.begin, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[k : k + n] = sizes
        self.begin[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.index.update(zip(kinds[0] + kinds[1] + kinds[2], range(k, k + n)))

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``, with the closing id."""
        if not self.parted:
            return np.array([*self.tool.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)
        lower = text.lower() if text.isascii() else text.encode().lower().decode()
        parts = _CLOSING.sub(r" \1", lower).replace("\n", " ").split(" ")
        if len(self.index) > self.most:
            self.clear()
        k = np.fromiter(map(self.index.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(k < 0)
        if len(missing):
            new = [parts[i] for i in missing]
            self._learn(list(dict.fromkeys(new)))
            k[missing] = list(map(self.index.__getitem__, new))
        size = self.size[k]
        ends = np.cumsum(size)
        total = int(ends[-1])
        out = np.empty(total + 1, np.uint32)
        out[:total] = self.ids[np.repeat(self.begin[k] - (ends - size), size) + np.arange(total)]
        out[total] = END_ID
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, window: int = 2048, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut every document's ids into full windows and a rest.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, on
    request, the ids. A null text has only the closing id.
    """
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        rows: dict[str, list] = {k: [] for k in kinds if with_ids or k != "ids"}
        for key, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = tool.encode(body or "")
            for at in range(0, len(ids), window):
                own = ids[at : at + window]
                rows["doc_id"].append(key)
                rows["start"].append(at)
                rows["length"].append(len(own))
                rows["ids_crc32"].append(zlib.crc32(own.astype("<u4").tobytes()))
                rows["doc_tokens"].append(len(ids))
                if with_ids:
                    rows["ids"].append(own.astype(np.int32))
        yield common.batch_of(rows, kinds)

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return common.map_arrow(source, run, schema)


@dataclass
class Plan:
    """Which pieces go where: of ``length``, those ranked from ``first`` on, ``repeat`` of them, fill
    ``offset`` of the sequences from ``sequence`` on, one each."""

    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)
    sequences: int = 0

    def add(self, lengths: list[int], repeat: int) -> None:
        at = 0
        for length in lengths:
            first = self.used.get(length, 0)
            self.rows.append((length, first, repeat, self.sequences, at))
            self.used[length] = first + repeat
            at += length
        self.sequences += repeat


def combinations(lengths: list[int], window: int) -> np.ndarray:
    """All pairs and triples of the given lengths that fill the window exactly, one a row; a pair has a 0 in the end.

    They are at most window / 2 and window^2 / 12, whatever the number of pieces.
    """
    have = np.zeros(window + 1, bool)
    have[[v for v in lengths if 0 < v < window]] = True
    own = np.flatnonzero(have)
    out = [np.zeros((0, 3), np.int32)]
    pairs = own[2 * own <= window]
    pairs = pairs[have[window - pairs]]
    out.append(np.column_stack([window - pairs, pairs, np.zeros_like(pairs)]))
    for c in own[3 * own <= window]:
        b = own[(own >= c) & (2 * own <= window - c)]
        b = b[have[window - c - b]]
        out.append(np.column_stack([window - c - b, b, np.full_like(b, c)]))
    return np.concatenate(out).astype(np.int32)


def non_negative(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 60, start: list[float] | None = None) -> np.ndarray:
    """Repeat counts x >= 0 that bring the columns' lengths closest to ``target``, by coordinate descent.

    Each step solves one count exactly with the others held, which never
    worsens the squared distance; ``start`` gives the counts to begin with.
    """
    parts = [tuple(sorted(set(c))) for c in columns]
    times = [tuple(c.count(v) for v in p) for c, p in zip(columns, parts)]
    norm = [sum(t * t for t in own) for own in times]
    x = list(start) if start is not None else [0.0] * len(columns)
    rest = target.astype(float).tolist()
    for own, t, n in zip(parts, times, x):
        for v, k in zip(own, t):
            rest[v] -= n * k
    for _ in range(sweeps):
        moved = 0.0
        for j, (own, t) in enumerate(zip(parts, times)):
            step = sum(rest[v] * k for v, k in zip(own, t)) / norm[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                for v, k in zip(own, t):
                    rest[v] -= step * k
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return np.array(x)


def fill(table: np.ndarray, target: np.ndarray, rounds: int = 12, each: int = 3) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Least squares over all rows of ``table``: the columns that take part, and their counts.

    Columns enter as they are wanted: each round looks at every column and adds
    those along which the distance still falls most, at most ``each`` for a
    length, then solves again from where it stood. It ends when no column is left
    that would bring half a repeat, or after ``rounds``; what is unsolved then is left to the greedy rest.
    """
    at: list[int] = []
    columns: list[tuple[int, ...]] = []
    x = np.zeros(0)
    used = table > 0
    size = used.sum(axis=1)
    for _ in range(rounds):
        rest = target.astype(float).copy()
        for c, n in zip(columns, x):
            for v in c:
                rest[v] -= n
        gain = np.where(used, rest[table], 0.0).sum(axis=1)
        gain[at] = 0.0
        wanted = np.flatnonzero(gain > 0.5 * size)
        taken, more = [0] * len(target), []
        first = wanted[np.argsort(-gain[wanted], kind="stable")][:20_000]  # others come in a later round
        for k, row in zip(first.tolist(), table[first].tolist()):
            own = [v for v in row if v]
            if all(taken[v] < each for v in own):
                for v in own:
                    taken[v] += 1
                more.append(k)
        if not more:
            break
        at += more
        columns += [tuple(int(v) for v in table[k][used[k]]) for k in more]
        x = non_negative(columns, target, 15, [*x, *[0.0] * len(more)])
        keep = np.flatnonzero(x > 0)
        at, columns, x = [at[k] for k in keep], [columns[k] for k in keep], x[keep]
    return columns, x


def plan(histogram: dict[int, int], window: int = 2048) -> Plan:
    """A packing of ``histogram[length]`` pieces of each length.

    Works on counts, not pieces, so its cost depends on ``window`` alone. Full
    windows stand alone; all pairs and triples that fill the window get rounded
    least-squares counts; what is left is packed longest first, each time with
    the longest lengths that still fit, as often as the counts allow.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = Plan()
    if left[window]:
        out.add([window], int(left[window]))
        left[window] = 0
    columns, counts = fill(combinations([int(v) for v in np.flatnonzero(left)], window), left)
    for column, x in sorted(zip(columns, counts), key=lambda p: (-p[1], p[0])):
        repeat = min([int(x + 0.5), *(int(left[v]) // column.count(v) for v in set(column))])
        if repeat > 0:
            out.add(list(column), repeat)
            for v in column:
                left[v] -= repeat
    have = [int(v) for v in np.flatnonzero(left)]
    while have:
        taken: dict[int, int] = {}
        space, high = window, len(have)
        while high := bisect.bisect_right(have, space, 0, high):
            length = have[high - 1]
            taken[length] = min(int(left[length]), space // length)
            space -= taken[length] * length
            high -= 1
        repeat = min(int(left[v]) // n for v, n in taken.items())
        out.add([v for v, n in taken.items() for _ in range(n)], repeat)
        for v, n in taken.items():
            left[v] -= n * repeat
        have = [v for v in have if left[v]]
    return out


def pack(docs: DataFrame, path: str, window: int = 2048, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, rows_per_bucket: int | None = None) -> DataFrame:
    """Cut and pack the ids of all documents into sequences of at most ``window``.

    Every id lies in exactly one piece, and pieces of one sequence lie one after
    another from offset 0. The driver gets one count per length (at most
    ``window``) and sends back the plan, whose rows depend on the number of
    lengths, not of documents; ranking the pieces of each length and joining the
    plan are Spark's. A null text packs as its closing id; repeated rows are
    packed each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cutout = common.cut(pieces(docs, path, window, doc_id, text, with_ids))
    counts = {r["length"]: r["n"] for r in cutout.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(counts, window)
    placed = spark.createDataFrame(made.rows, "p_length int, p_first long, p_repeat long, p_sequence long, p_offset long")
    ranked = common.gapless(cutout, "length", ["doc_id", "start", "ids_crc32"], ["doc_id", "start"], rows_per_bucket, "rank")
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_first")) & (F.col("rank") < F.col("p_first") + F.col("p_repeat"))
    joined = ranked.join(F.broadcast(placed), fits)
    more = ["ids"] * with_ids
    return joined.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("p_sequence") + F.col("rank") - F.col("p_first")).alias("sequence_id"), F.col("p_offset").alias("offset"), *more,
    )
