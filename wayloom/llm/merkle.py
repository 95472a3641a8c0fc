"""A Merkle manifest of a dataset: digests of rows, subtrees per group, inclusion proofs, and their verification.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text. Leaves of a group ascend
by key; every two consecutive nodes become their H, a last one alone too, until one is left: the
group's subroot (a lone leaf itself). Subroots in order of group make the root by the same rule.

Leaves are numbered in a range shuffle of digests; texts are not shuffled. Every ``2 ** depth``
consecutive leaves are a superblock, whose top is a leaf of the next round, so no task holds more than that many
nodes whatever the group's size. On the way back the nodes of a superblock are cogrouped with the
path above its top; one ``applyInPandas`` reduces the block, joins the proofs and folds the claims.

Defined cases. A null field of a leaf counts as ``-``, an empty one as ``0:``. A null group is a group of its own, before
all others; null keys come before all others. Rows of equal key are in order of their leaves, so their order
in the input does not matter. An empty table gives no row. Extra columns are ignored. A null claim
claims the leaf itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: Levels of the tree within one superblock: at most 1,024 nodes to a task at once.
DEPTH = 10


def leaf_digest(fields: Iterable[Column]) -> Column:
    """H of the fields in order: ``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _h(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _levels(total: int, depth: int) -> int:
    """Levels within a block of a row of ``total`` nodes."""
    return min(depth, max(0, total - 1).bit_length())


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level of a block, from the lowest; the last level has one."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def _sibling(below: list[str], at: int) -> str:
    """The other node of the pair of ``at`` with its side: '<...' on the left, '>...' on the right, '' if there is none."""
    other = at ^ 1
    return "" if other >= len(below) else ("<" if other < at else ">") + below[other]


def fold(digest: str, path: Iterable[str]) -> str:
    """The digest at the end of a path of siblings."""
    for step in path:
        digest = _h(digest) if not step else _h(step[1:], digest) if step[0] == "<" else _h(digest, step[1:])
    return digest


def proof_digest(path: Iterable[str]) -> str:
    """H of the siblings of a path."""
    return _h(*(step[1:] for step in path))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 without gaps in each group, by ``order``) and ``total``, the group's rows.

    One range shuffle; rows are numbered in their sorted partition as they are written.
    A small table of partition and group then says where each begins.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    # equal rows may be many: another column spreads them over ranges
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    by = [group, *order, "_salt"]
    dealt = salted.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt.drop("_salt").write.parquet(path)
    kept = spark.read.schema(dealt.drop("_salt").schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    spans = stored(kept.groupBy("_part", group).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n")))
    begins = spans.selectExpr("_part as _p", f"{group} as _g", f"_from - (sum(_n) over (partition by {group} order by _part) - _n) as _base", f"sum(_n) over (partition by {group}) as total")
    out = kept.join(begins, (F.col("_part") == F.col("_p")) & (F.col(group) == F.col("_g")))
    return out.withColumn("pos", F.col("_at") - F.col("_base")).drop("_at", "_part", "_p", "_g", "_base")


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """grp, pos, total, digest of the tops of the superblocks of ``nodes`` (of the same columns)."""

    def top(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        total = int(block["total"].iloc[0])
        last = _reduced(block["digest"].tolist(), _levels(total, depth))[-1]
        return pd.DataFrame({"grp": block["grp"].iloc[:1], "pos": block["pos"].iloc[:1] // (1 << depth), "total": [((total - 1) >> depth) + 1], "digest": last})

    return nodes.select("grp", "pos", "total", "digest").groupBy("grp", F.shiftright("pos", depth).alias("block")).applyInPandas(top, "grp string, pos long, total long, digest string")


def _raised(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """``nodes`` and the rounds of tops above them, up to one for each group."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(stored(_tops(out[-1], depth)))
    return out


_PATHS = "grp string, pos long, path array<string>, subroot string, root string"


def _paths(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """The paths of ``nodes``, cogrouped by superblock with the paths of the tops ``above`` them."""

    def join(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, over = block.sort_values("pos"), outer.iloc[0]
        levels = _reduced(block["digest"].tolist(), _levels(int(block["total"].iloc[0]), depth))
        own = [[*(_sibling(below, i >> k) for k, below in enumerate(levels[:-1])), *over["path"]] for i in range(len(block))]
        return pd.DataFrame({"grp": block["grp"], "pos": block["pos"], "path": own, "subroot": over["subroot"], "root": over["root"]})

    return _met(nodes.select("grp", "pos", "total", "digest"), above, depth).applyInPandas(join, _PATHS)


def _met(nodes: DataFrame, above: DataFrame, depth: int):
    """Nodes and the paths of the tops above them, cogrouped by superblock."""
    return nodes.groupBy("grp", F.shiftright("pos", depth)).cogroup(above.groupBy("grp", "pos"))


def _proved(leaves: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """The last exchange: blocks of leaves reduced, their proofs joined to those above, and all claims folded."""

    def prove(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, over = block.sort_values("pos"), outer.iloc[0]
        path = list(over["path"])
        levels = _reduced(block["digest"].tolist(), _levels(int(block["total"].iloc[0]), depth))
        ends: dict[str, str] = {}
        proofs, folded = [], []
        for i, claim in enumerate(block["claimed"]):
            own = [_sibling(below, i >> k) for k, below in enumerate(levels[:-1])]
            inner = fold(claim, own)
            # claims that agree at the block's top agree from there on
            if inner not in ends:
                ends[inner] = fold(inner, path)
            folded.append(ends[inner])
            proofs.append(proof_digest([*own, *path]))
        return pd.DataFrame({"grp": block["grp"], "_key": block["_key"], "leaf": block["digest"], "subroot": over["subroot"], "root": over["root"], "proof_sha256": proofs, "folded_root": folded})

    schema = "grp string, _key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return _met(leaves, above, depth).applyInPandas(prove, schema)


def manifest(leaves: DataFrame, key: str = "doc_id", group: str = "lang", depth: int = DEPTH) -> DataFrame:
    """key, group, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``leaves``.

    ``leaves``: ``key``, ``group``, ``leaf`` and ``claimed``, the digest whose inclusion is to be
    verified against the root by the siblings of ``leaf``. ``verified`` says whether it folds to the root.
    """
    kinds = dict(leaves.dtypes)
    # text that sorts as the groups do, null first
    named = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = leaves.select(named.alias("grp"), F.col(key).alias("_order"), F.col("leaf").alias("digest"), F.coalesce("claimed", "leaf").alias("claimed"))
    rows = numbered(rows, "grp", ["_order", "digest"]).withColumn("_key", F.col("_order").cast("string")).drop("_order")
    rounds = _raised(rows, depth)
    subroots = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    langs = stored(numbered(subroots, "grp", ["of"]))
    over = _raised(langs, depth)
    paths = over[-1].select("grp", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for level in reversed(over[:-1]):
        paths = _paths(level, paths, depth)
    tops = langs.join(paths.select("pos", "path", "root"), "pos")
    paths = stored(tops.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"))
    for level in reversed(rounds[1:-1]):
        paths = _paths(level, paths, depth)
    found = _proved(rows, paths, depth)
    back = F.when(F.col("grp") == "", F.lit(None)).otherwise(F.expr("substr(grp, 2)")).cast(kinds[group])
    return found.select(F.col("_key").cast(kinds[key]).alias(key), back.alias(group), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
