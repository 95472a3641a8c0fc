"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of their centred integer form.

An entry c becomes x = floor(1024 c) + 100000. Centring is exact: with n vectors and
sums S, the integers n x - S are divided by n, so the large common offset costs no digits.

Each step multiplies the centred rows A by one vector v and their transpose by the
outcome u, in one pass of partial sums. Both sides are fully reorthogonalised: the
driver holds the few right vectors V, Z = A'U and the triangle T of A V = U T; the long left vectors
are made again from them inside each pass, so no column of the length of the table is kept.
The SVD of T, which is bidiagonal but for rounding and restarts, gives components and deviations.

Defined cases. A null vector, one with a null, NaN or infinite entry, and one whose
length is not that of most vectors (of equally many, the longer) is left out. Repeated rows count
each. A null id stays null. Extra columns are ignored. Without a direction of variance (no
row, one row, equal rows) there is no component and no result row; of rank r there are at most r.
Equal eigenvalues have some orthonormal basis of their space. Vectors have no cap on their number;
a task holds a block of 1,000 at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, map_arrow, scratch, sliced

SCALE, OFFSET = 1024, 100_000

#: A singular value below this share of the largest is rounding, not variance.
NOTHING = 1e-10

#: Residual, as a share of the largest singular value, at which a triplet is done.
DONE = 1e-13


@dataclass
class Whitening:
    """What ``fit`` finds: exact sums, components as columns, and their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None
    passes: int

    @property
    def width(self) -> int:
        return len(self.sums)


def usable(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """_id, _v: rows whose vector has only finite entries, as doubles."""
    own = df.select(F.col(id_).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    return own.filter(F.col("_v").isNotNull() & finite)


def _integers(column: pa.Array, width: int) -> np.ndarray:
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    x = np.floor(c * float(SCALE))
    if len(x) and np.abs(x).max() >= 2.0**62:
        return np.array([[int(e) + OFFSET for e in row] for row in x], object)
    return x.astype(np.int64) + OFFSET


def _shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as 64-bit integers where they fit, else as Python integers."""
    base = [s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, base)]
    if x.dtype != object and max((abs(b) for b in base), default=0) < 1 << 61:
        away = x - np.array(base, np.int64)
        if not len(away) or int(np.abs(away).max()) * n + n < 1 << 62:
            return away * n - np.array(rest, np.int64)
        x = x.astype(object)
    return (x - np.array(base, object)) * n - np.array(rest, object)


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """The vectors once more, 1,000 to a row: size, entry bytes (4, 8, or 0 for decimal text), x, sums."""

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _integers(batch.column("_v"), width)
        if not len(x):
            return
        small = x.dtype != object and np.abs(x).max() < 1 << 31
        kind = 0 if x.dtype == object else 4 if small else 8
        data = " ".join(map(str, x.ravel())).encode() if not kind else x.astype(np.int32 if small else np.int64).tobytes()
        exact = x.sum(0) if kind == 4 else x.astype(object).sum(0)
        sums = pa.array([[Decimal(int(s)) for s in exact]], pa.list_(pa.decimal128(38, 0)))
        yield batch_of({"size": pa.array([len(x)], pa.int32()), "kind": pa.array([kind], pa.int32()), "x": pa.array([data], pa.binary()), "sums": sums})

    return map_arrow(rows.select("_v"), pack, "size int, kind int, x binary, sums array<decimal(38,0)>")


def _unpacked(size: int, kind: int, data: bytes) -> np.ndarray:
    if not kind:
        return np.array([int(e) for e in data.split()], object).reshape(size, -1)
    return np.frombuffer(data, np.int32 if kind == 4 else np.int64).reshape(size, -1).astype(np.int64)


def _total(blocks: DataFrame, n: int, sums: list[int], f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``f(A)`` over all blocks A of centred rows: per task, then over groups of tasks, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                part = f((_shifted(_unpacked(**{"size": row["size"], "kind": row["kind"], "data": row["x"]}), n, sums) / n).astype(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield batch_of({"part": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part").to_pylist():
                values = np.frombuffer(part)
                total = values.copy() if total is None else total + values
        if total is not None:
            yield batch_of({"part": pa.array([total.tobytes()], pa.binary())})

    parts = blocks.select("size", "kind", "x").mapInArrow(partial, "part binary")
    groups = max(1, math.isqrt(blocks._tasks))
    got = parts.repartition(groups).mapInArrow(add, "part binary").collect()
    return np.sum([np.frombuffer(r["part"]) for r in got], axis=0)


def _fresh(rng: np.random.Generator, V: np.ndarray) -> np.ndarray:
    """A random unit vector orthogonal to the columns of V."""
    v = rng.standard_normal(len(V))
    for _ in range(3):
        v -= V @ (V.T @ v)
        v /= np.linalg.norm(v)
    return v


def bidiagonalise(product: Callable[[np.ndarray, list[int], np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]], width: int, norm: float, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest singular values of A and their right vectors (columns), and the number of passes.

    ``product(V, pivots, T, v_and_c)`` makes r = A v - U c and returns |r|^2, A'r
    and U'r. A column of V that adds nothing to the range of A has no left vector;
    ``pivots`` names those that have. Where a chain ends in an invariant subspace, another begins in a
    random direction orthogonal to it. Where the wanted triplets are done before all
    directions are used, a second chain as long as the first looks for further copies of equal values.
    """
    rng = np.random.default_rng(seed)
    V, Z, S = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((0, 0))
    pivots: list[int] = []
    v, again = _fresh(rng, V), 0
    while True:
        c = Z.T @ v
        square, back, more = product(V, pivots, S, np.concatenate([v, c]))
        # the second round of Gram-Schmidt, from the measured U'r
        c, square, back = c + more, square - more @ more, back - Z @ more
        alpha = math.sqrt(max(square, 0.0))
        V = np.column_stack([V, v])
        S = np.column_stack([S, c]) if len(S) else np.zeros((0, V.shape[1]))
        beta = 0.0
        if alpha > 1e-13 * norm:
            S = np.vstack([S, np.zeros(V.shape[1])])
            S[-1, -1] = alpha
            pivots.append(V.shape[1] - 1)
            z = back / alpha
            Z = np.column_stack([Z, z])
            v = z - V @ (V.T @ z)
            v -= V @ (V.T @ v)
            beta = float(np.linalg.norm(v))
        steps = V.shape[1]
        P, values, Qt = np.linalg.svd(S, full_matrices=False) if len(S) else (np.zeros((0, 0)), np.zeros(0), np.zeros((0, steps)))
        if steps == width:
            break
        rest = (Z - V @ (V.T @ Z)) @ P[:, :wanted] if len(S) else np.zeros((width, 0))
        done = len(values) >= wanted and np.linalg.norm(rest, axis=0).max() <= DONE * values[0]
        if done and again and steps >= again:
            break
        if done and not again:
            again, beta = 2 * steps, 0.0
        v = v / beta if beta > 1e-13 * norm else _fresh(rng, V)
    top = V @ Qt[:wanted].T
    return values[:wanted], top, steps


def fit(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = 8) -> Whitening:
    """The ``components`` directions of most variance of all usable vectors of ``df``, fewer where the rank is less."""
    rows = usable(df, id_, vector)
    sizes = rows.groupBy(F.size("_v").alias("width")).count().filter("width > 0").orderBy(F.desc("count"), F.desc("width"))
    top = sizes.first()
    if top is None:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, None, 0)
    width = top["width"]
    path = scratch(df.sparkSession)
    _blocks(rows.filter(F.size("_v") == width), width).write.parquet(path)
    blocks = df.sparkSession.read.schema("size int, kind int, x binary, sums array<decimal(38,0)>").parquet(path)
    blocks._tasks = blocks.rdd.getNumPartitions()
    n = blocks.agg(F.sum("size")).first()[0]
    each = blocks.select(F.posexplode("sums").alias("pos", "s")).groupBy("pos").agg(F.sum("s").alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(each, key=lambda r: r["pos"])]
    squares = float(_total(blocks, n, sums, lambda A: np.array([np.square(A).sum()]))[0])
    none = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), squares / n, None, 1)
    if squares == 0.0:
        return none

    def product(V: np.ndarray, pivots: list[int], S: np.ndarray, asked: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        v, c, right, k = asked[:width], asked[width:], V[:, pivots], len(pivots)

        def one(A: np.ndarray) -> np.ndarray:
            Y, U = A @ right, np.zeros((len(A), k))
            for i, at in enumerate(pivots):
                U[:, i] = (Y[:, i] - U[:, :i] @ S[:i, at]) / S[i, at]
            r = A @ v - U @ c
            return np.concatenate([[r @ r], A.T @ r, U.T @ r])

        got = _total(blocks, n, sums, one)
        return float(got[0]), got[1 : 1 + width], got[1 + width :]

    values, directions, passes = bidiagonalise(product, width, math.sqrt(squares), min(components, width))
    real = values > NOTHING * values[0]
    values, directions = values[real], directions[:, real]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    model = Whitening(n, sums, directions, np.square(values) / n, squares / n, None, passes + 2)
    per = directions / np.sqrt(model.eigenvalues)
    k = len(values)

    def moments(A: np.ndarray) -> np.ndarray:
        W = A @ per
        return np.concatenate([W.sum(0), (W.T @ W).ravel()])

    got = _total(blocks, n, sums, moments)
    mean = got[:k] / n
    model.identity_error = float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def transform(df: DataFrame, model: Whitening, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, deviation (decimal(38,0), null beyond 38 digits), whitened (array by component) of every vector that ``fit`` takes."""
    n, sums, width, k = model.n, model.sums, model.width, len(model.eigenvalues)
    kind = df.schema[id_].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    per = model.components / np.sqrt(model.eigenvalues) if k else np.zeros((width, 0))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        away = _shifted(_integers(batch.column("_v"), width), n, sums)
        if away.dtype == object or float(np.abs(away).max(initial=0)) ** 2 * width >= 2.0**62:
            away = away.astype(object)
        whole = [int(s) for s in (away * away).sum(1)]
        W = (away / n).astype(np.float64) @ per
        deviation = pa.array([Decimal(s) if s < 10**38 else None for s in whole], pa.decimal128(38, 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(W) * k + 1, k) if k else np.zeros(len(W) + 1), pa.int32()), pa.array(W.ravel()))
        yield batch_of({"_id": batch.column("_id"), "deviation": deviation, "whitened": lists})

    rows = usable(df, id_, vector).filter(F.size("_v") == width) if n and k else usable(df, id_, vector).filter("false")
    out = map_arrow(rows, each, schema)
    return out.withColumnRenamed("_id", id_)


def whiten(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """One row for each usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit(df, id_, vector, components)
    share = [float(e / model.trace) for e in model.eigenvalues]
    rows = transform(df, model, id_, vector).select(id_, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    shares = F.array(*map(F.lit, share)) if share else F.array(F.lit(0.0))
    return rows.select(
        id_, (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
