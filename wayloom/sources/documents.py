"""Large JSON documents, read by many tasks.

A document is one object whose members are objects or arrays of objects. Spark's text reader cuts
it after closing braces, in blocks of bytes as usual, so no task reads it whole. What a block means
depends on what is open where it begins: a first scan finds what each block closes and opens, both
if it begins inside a string and if not, in one row a block; these rows in order tell the
state at every block. A second scan then takes the elements out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]]', re.S)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.S)

#: What is open: a bracket, and the member name before it.
Stack = list[tuple[str, str | None]]


def follow(piece: str, inside: bool, stack: Stack, opened: Callable[[int], None] | None = None) -> tuple[bool, int]:
    """Follow a piece of text and the brace that closes it; ``stack`` changes.

    Returns whether a string goes on behind that brace, and how many brackets were
    closed that ``stack`` did not hold. ``opened`` is told each place where a bracket has been put on.
    """
    at, name, lost = 0, None, 0
    if inside:
        rest = _REST.match(piece)
        if not rest[1]:
            return True, 0
        at = rest.end()
    for token in _TOKEN.finditer(piece, at):
        text = token[0]
        if text[0] == '"':
            if not token[1]:
                return True, lost
            name = text[1:-1]
        elif text in "{[":
            stack.append((text, name))
            name = None
            if opened:
                opened(token.start())
        elif stack:
            stack.pop()
        else:
            lost += 1
    if stack:
        stack.pop()
    else:
        lost += 1
    return False, lost


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        paths, blocks, values = (batch.column(c) for c in ("path", "block", "value"))
        for i in range(batch.num_rows):
            yield (paths[i].as_py(), blocks[i].as_py()), values[i].as_py()


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: what it closes and opens, begun outside and inside a string."""
    at, ways = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [at[0]], "block": pa.array([at[1]], pa.int64()), "effect": [json.dumps(ways)]})

    for key, piece in _pieces(batches):
        if key != at:
            if at:
                yield row()
            at, ways = key, [[False, 0, []], [True, 0, []]]
        for way in ways:
            way[0], lost = follow(piece, way[0], way[2])
            way[1] += lost
    if at:
        yield row()


def _states(effects: DataFrame) -> dict[tuple[str, int], tuple[bool, Stack]]:
    """Whether each block begins inside a string, and what is open there."""
    out, path, inside, stack = {}, None, False, []
    for row in effects.orderBy("path", "block").toLocalIterator():
        if row["path"] != path:
            path, inside, stack = row["path"], False, []
        out[path, row["block"]] = (inside, list(stack))
        inside, lost, opened = json.loads(row["effect"])[inside]
        stack = stack[: max(len(stack) - lost, 0)] + [tuple(o) for o in opened]
    return out


def _item(stack: Stack) -> int:
    """How many brackets are open around the element that ``stack`` is in; 0 outside all elements."""
    if len(stack) > 1 and stack[1][0] == "{":
        return 1
    return 2 if len(stack) > 2 and stack[2][0] == "{" else 0


def _taken(states: dict[tuple[str, int], tuple[bool, Stack]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parts of elements: n counts those of a member begun in the block; a part with n = -1 goes on from an earlier block."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "block": pa.int64(), "member": pa.string(), "n": pa.int64(), "whole": pa.bool_(), "text": pa.string()}
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, begins = [], [], []
        at, inside, stack, counts, member, n = None, False, [], {}, None, -1

        def opened(place: int) -> None:
            depth = _item(stack)
            if depth and len(stack) == depth + 1:
                begins.append((place, stack[1][1]))

        for key, piece in _pieces(batches):
            if key != at:
                if held:
                    rows.append((*at, member, n, False, "".join(held)))
                    held.clear()
                at, counts, n = key, {}, -1
                inside, stack = states[key][0], list(states[key][1])
                member = stack[1][1] if len(stack) > 1 else None
            within = _item(stack) > 0
            begins.clear()
            inside, _ = follow(piece, inside, stack, opened)
            # braces close at the end of a piece only, so a piece begins one element at most
            if within:
                held.append(piece + "}")
            elif begins:
                place, member = begins[0]
                n = counts.get(member, 0)
                counts[member] = n + 1
                held.append(piece[place:] + "}")
            if held and not _item(stack):
                rows.append((*at, member, n, n >= 0, "".join(held)))
                held.clear()
                n = 0
            if len(rows) >= 10_000:
                yield batch(rows)
                rows = []
        if held:
            rows.append((*at, member, n, False, "".join(held)))
        if rows:
            yield batch(rows)

    return run


def elements(spark: SparkSession, path: str) -> DataFrame:
    """path, member, pos, value: the objects of a document's members in their order, as JSON text.

    ``path``: a document or a folder of them. An element of an array has its place there as pos (other
    values than objects are not counted); an object that is a member itself has 0. Text
    is read by blocks of ``spark.sql.files.maxPartitionBytes``; an element that lies over several
    blocks is put together again, and only such elements are shuffled. The driver keeps one row for each block,
    and the document must be valid JSON.
    """
    pieces = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    states = _states(pieces.mapInArrow(_effects, "path string, block long, effect string"))
    parts = graph.cut(pieces.mapInArrow(_taken(states), "path string, block long, member string, n long, whole boolean, text string"))
    begun = parts.filter("n >= 0").groupBy("path", "member", "block").agg(F.count(F.lit(1)).alias("begun"))
    blocks = parts.select("path", "member", "block").distinct().join(begun, ["path", "member", "block"], "left")
    before = blocks.selectExpr("path", "member", "block", "coalesce(sum(begun) over (partition by path, member order by block rows between unbounded preceding and 1 preceding), 0) as before")
    placed = parts.join(before, ["path", "member", "block"]).withColumn("pos", F.col("before") + F.col("n"))
    whole = placed.filter("whole").select("path", "member", "pos", F.col("text").alias("value"))
    over = placed.filter("not whole").groupBy("path", "member", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    return whole.unionByName(over.select("path", "member", "pos", F.array_join("p.text", "").alias("value")))


def members(found: DataFrame, member: str, schema: str) -> DataFrame:
    """path, pos and ``e``, the elements of one member of ``elements`` under a schema."""
    return found.filter(F.col("member") == member).select("path", "pos", F.from_json("value", schema).alias("e"))
