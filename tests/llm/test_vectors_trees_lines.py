"""Whitening, Merkle manifest, line dedup: against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wayloom.llm")

from wayloom.llm import line_dedup, merkle, queries, whitening  # noqa: E402

from .test_text_operators import DOCS, EDGE, frame, low  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, component int, n long, deviation string, _v int"


def vectors(spark, rows):
    """Embeddings with extra columns whose names clash with those of the result."""
    return spark.createDataFrame([(i, None if v is None else list(map(float, v)), 3, 9, "x", 1) if v is None or None not in v else (i, v, 3, 9, "x", 1) for i, v in rows], VECTORS)


def check_whitening(rows, got, most=8):
    """``got`` against exact sums and a dense eigendecomposition of the integer form of ``rows`` (id, vector)."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    A = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    values, Q = np.linalg.eigh(A.T @ A / n)
    values, Q = values[::-1], Q[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, k + 1)) and all(len(v) == n for v in by.values())
    want = A @ Q[:, :k] / np.sqrt(values[:k])
    dev = {}
    for (i, _), r in zip(rows, x):
        dev.setdefault(i, []).append(sum((n * c - s) ** 2 for c, s in zip(r, sums)))
    for j in range(1, k + 1):
        mine = by[j]
        assert {r["n"] for r in mine} == {n} and len({(r["explained"], r["identity_error"]) for r in mine}) == 1
        assert mine[0]["identity_error"] < 1e-9 and mine[0]["explained"] == pytest.approx(values[j - 1] / values.sum(), rel=1e-9)
        assert sorted(int(r["deviation"]) for r in mine) == sorted(d for ds in dev.values() for d in ds)
    return by, want, values[:k]


def same_directions(rows, by, want):
    at = {i: p for p, (i, _) in enumerate(rows)}
    for j, mine in by.items():
        w = np.array([want[at[r["vec_id"]], j - 1] for r in mine])
        g = np.array([r["whitened"] for r in mine])
        assert min(np.abs(g - w).max(), np.abs(g + w).max()) < 1e-6


def test_whitening_query_against_dense_eigenvectors(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert all(v is not None and None not in v for _, v in rows)
    got = queries.op11_whitening(spark, sf).collect()
    by, want, _ = check_whitening(rows, got)
    same_directions(rows, by, want)


def test_whitening_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)]
    good += [(None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [math.nan] * 5), (903, [math.inf, 0, 0, 0, 0]), (904, []), (905, [1.0, 2.0]), (906, [1.0] * 6)]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    by, want, _ = check_whitening(good, got)
    same_directions(good, by, want)
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_whitening_of_repeated_rows_low_rank_and_equal_eigenvalues(spark):
    plane = [(i, [a, b, a + b, 0.0]) for i, (a, b) in enumerate([(3, 1), (-3, 1), (3, -1), (-3, -1), (7, 2), (7, 2), (7, 2)])]
    by, _, values = check_whitening(plane, whitening.whiten(vectors(spark, plane)).collect())
    assert len(by) == 2
    round_ = [(i, [s * (j == k) for j in range(4)]) for i, (k, s) in enumerate((k, s) for k in range(4) for s in (1, -1))]
    by, _, values = check_whitening(round_, whitening.whiten(vectors(spark, round_)).collect())
    assert len(by) == 4 and np.ptp(values) < 1e-6 * values[0]


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [4.0, 4.0]) for i in range(5)], [(1, None)], [(1, [])]):
        out = whitening.whiten(vectors(spark, rows))
        assert out.columns[:3] == ["vec_id", "component", "n"] and out.count() == 0


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(i, [v, 2.0 * i]) for i, v in enumerate([1e12, -3e14, 2.5e15, 7.0])]
    by, _, _ = check_whitening(rows, whitening.whiten(vectors(spark, rows)).collect())
    rows = [(i, [v, 2.0 * i]) for i, v in enumerate([1e30, -1e30, 5.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["deviation"] for r in got} >= {None} and {r["n"] for r in got} == {3}


def test_bidiagonalisation_finds_copies_of_equal_singular_values():
    rng = np.random.default_rng(3)
    left, right = np.linalg.qr(rng.standard_normal((200, 60)))[0], np.linalg.qr(rng.standard_normal((60, 60)))[0]
    sizes = np.concatenate([[50.0] * 3, [40.0] * 2, [30.0, 20.0, 20.0], 5 * 0.5 ** np.arange(52)])
    A = (left * sizes) @ right.T

    def product(V, pivots, S, asked):
        v, c, k = asked[:60], asked[60:], len(pivots)
        Y, U = A @ V[:, pivots], np.zeros((len(A), k))
        for i, at in enumerate(pivots):
            U[:, i] = (Y[:, i] - U[:, :i] @ S[:i, at]) / S[i, at]
        r = A @ v - U @ c
        return float(r @ r), A.T @ r, U.T @ r

    values, directions, steps = whitening.bidiagonalise(product, 60, np.linalg.norm(A), 8)
    assert np.allclose(values, sizes[:8], rtol=1e-12) and steps < 60
    assert np.allclose(A.T @ (A @ directions), directions * sizes[:8] ** 2, atol=1e-9 * 2500)
    assert np.allclose(directions.T @ directions, np.eye(8), atol=1e-12)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    return [[(j < at >> k, level[j]) for j in [(at >> k) ^ 1] if j < len(level)] for k, level in enumerate(levels[:-1])]


def brute_manifest(rows):
    """(doc_id, lang, leaf, claim) to the rows of a manifest."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    trees = {g: tree([r[2] for r in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for at, (id_, _, leaf, claim) in enumerate(groups[g]):
            path = siblings(trees[g], at) + siblings(top, i)
            folded = claim or leaf
            for step in path:
                folded = h(folded) if not step else h(step[0][1], folded) if step[0][0] else h(folded, step[0][1])
            out.append((id_, g, leaf, trees[g][-1][0], top[-1][0], h(*(s for step in path for _, s in step)), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("depth", [1, 2, 10])
def test_manifest_against_a_plain_tree(spark, depth):
    rows = [(i, "en", h(str(i)), h("x") if i % 5 == 0 else None) for i in range(37)]
    rows += [(i, None, h("n", str(i)), None) for i in range(8)] + [(1, "", h("e"), None), (4, "é", h("a"), h("b")), (None, "fr", h("0"), None), (None, "fr", h("1"), h("2"))]
    rows += [(7, "fr", h("same"), None)] * 5 + [(i, "zz", h("z", str(i)), None) for i in range(17)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, lang string, leaf string, claimed string, path string, total int")
    got = merkle.manifest(df, depth=depth)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_manifest(rows)))


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(5, None, h("a"), None)], "doc_id long, lang string, leaf string, claimed string")
    assert [tuple(r) for r in merkle.manifest(one).collect()] == brute_manifest([(5, None, h("a"), None)])
    assert merkle.manifest(one.limit(0)).count() == 0
    two = spark.createDataFrame([(5, g, h(g), None) for g in "ab"], "doc_id long, lang string, leaf string, claimed string")
    assert sorted(map(tuple, merkle.manifest(two).collect())) == sorted(brute_manifest([(5, g, h(g), None) for g in "ab"]))


def test_manifest_query_by_brute_force(spark, sf):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        leaf = h(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
        more = None if r["n_chars"] is None else r["n_chars"] + 1
        claim = h(field(r["doc_id"]), field(r["source"]), field(r["lang"]), field(more), field(r["text"])) if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else None
        rows.append((r["doc_id"], r["lang"], leaf, claim))
    want = [(r[0], *r[2:]) for r in brute_manifest(rows)]
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, sf).collect()]
    assert sorted(got) == sorted(want) and 0 < sum(r[-1] for r in got) < len(got)


def test_leaf_digest_of_nulls_and_long_fields(spark):
    df = spark.createDataFrame([(1, None, "é" * 50_000), (None, "", None)], "a long, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf_digest([F.col(c) for c in "abc"])).collect()]
    assert got == [h("1:1", "-", "100000:" + "é" * 50_000), h("-", "0:", "-")]


def brute_lines(rows, least=3, chars=20):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= chars:
                held[k].append(-math.inf if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = -math.inf if i is None else i
        kept = [x for x in lines if len(held.get(key(x), ())) < least or own >= max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = [
    *EDGE, (20, "  A line that Many documents HAVE\nown words of twenty\n"), (21, "a line that many documents have \n\nA LINE THAT MANY DOCUMENTS HAVE"),
    (22, "\x0b\x0ca line that many documents have\r\nnineteen characters"), (19, "nineteen characters\nnineteen characters\nÉ long line with an É in it"),
    (18, "nineteen characters\né long line with an é in it"), (17, "É long line with an É in it"), (16, "É long line with an É in it"), (15, "twenty ééééééééééé x"), (14, "twenty ééééééééééé x"),
    (13, "twenty ééééééééééé x"), (22, "a line that many documents have"), (None, "a line that many documents have\nrest"), (30, "\n".join(["a line that only one document has"] * 9)), (31, "\n\n"),
]


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_BYTES, -1])
def test_lines_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "UNIT_PROBES", 3)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "HELD_KEYS", 4)
    docs = frame(spark, LINES).withColumn("n_lines", F.lit("old"))
    got = line_dedup.drop_lines(docs, broadcast_bytes=most)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "row", "id", "word", "text", "n_lines", "n_dropped"]
    shown = got.select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(repr, map(tuple, shown))) == sorted(map(repr, brute_lines(LINES)))
    assert line_dedup.drop_lines(docs.limit(0), broadcast_bytes=most).count() == 0


def test_line_query_and_shards_agree_with_brute_force(spark, sf, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, d, h(t)) for i, n, d, t in brute_lines(rows))
    assert sum(r[2] for r in want) > 0
    assert sorted(map(tuple, queries.op13_line_dedup(spark, sf).collect())) == want
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    monkeypatch.setattr(line_dedup, "UNIT_PROBES", 50)
    far = line_dedup.drop_lines(spark.read.parquet(f"{sf}/documents.parquet"), broadcast_bytes=-1)
    assert sorted(map(tuple, far.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect())) == want


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 20_000):
        h1, h2 = rng.integers(-(1 << 63), 1 << 63, (2, n), np.int64)
        h1[: n // 2] = h1[0] if n else 0  # halves may be equal, pairs not
        sizes, bits, at = line_dedup.build(h1, h2)
        assert sorted(at.tolist()) == list(range(n))
        assert n < 1000 or len(bits) * 64 < 6 * n
    shards, rows = 3, []
    h1, h2 = rng.integers(-(1 << 63), 1 << 63, (2, 3000), np.int64)
    own = (h1.view(np.uint64) % np.uint64(shards)).astype(int)
    for s in (2, 0, 1):
        mine = np.flatnonzero(own == s)
        sizes, bits, at = line_dedup.build(h1[mine], h2[mine])
        prints, tops = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
        prints[at], tops[at] = h1[mine], mine
        rows.append({"shard": s, "n": len(mine), "sizes": sizes, "bits": bits.tobytes(), "prints": prints.tobytes(), "counts": np.zeros(len(mine), "<u4").tobytes(), "tops": tops.tobytes()})
    found = line_dedup.Index(rows, shards)
    assert (found.tops[found.find(h1, h2)] == np.arange(3000)).all()
    s1, s2 = rng.integers(-(1 << 63), 1 << 63, (2, 50_000), np.int64)
    assert (found.find(s1, s2) == -1).all()
