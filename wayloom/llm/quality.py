"""Quality classifier: how much better a text compresses with a dictionary of good text than of bad."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the line that turns a size difference into log odds."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    piece: int = 512
    level: int = 3

    def compressors(self) -> tuple:
        made = []
        for raw in (self.good, self.bad):
            own = zstandard.ZstdCompressionDict(raw) if raw else None
            more = {"dict_data": own} if own else {}
            made.append(zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False, **more))
        return tuple(made)

    def difference(self, text: bytes, tools: tuple) -> float:
        """(size with the bad dictionary - size with the good one) / length, over all pieces of the text."""
        good, bad = tools
        size = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(text, self.piece))
        return size / max(1, len(text))

    def score(self, difference: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -40, 40))))


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    for at in range(0, len(text), size):
        yield text[at : at + size]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train one."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, slightly pulled to 0, by Newton steps."""
    scale = float(np.std(x)) or 1.0
    a = np.column_stack([x / scale, np.ones_like(x)])
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (w * (p - y)) + 1e-3 * b
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def fit(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    per_class: int = 2000, pieces_per_doc: int = 16, dictionary_size: int = 112_640, piece: int = 512,
) -> Model:
    """Learn both dictionaries and the calibration from labelled rows.

    The sample is bounded by parameters: of each class at most ``per_class``
    documents for the dictionaries, each giving at most ``pieces_per_doc`` pieces
    of ``piece`` bytes spread over its text, and as many other documents, scored
    whole on the executors, for the calibration; the classes are weighted by
    their number of labels. ``train`` (over the label's id column) says which
    labels may be learned from. Rows without label are left out; an id in several
    rows gives the smallest label and text. With no label or one class the score
    is that class's share, softened.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(f"`{doc_id}`").alias("id"), F.col(label).cast("int").alias("y"))
    if train is not None:
        known = known.filter(train)
    known = known.filter("id is not null").groupBy("id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))), piece)
    order = F.xxhash64(F.lit("quality"), "id")
    chosen = None
    for y in (0, 1):
        # where a class is scarce, half of it serves each purpose
        most = min(2 * per_class, counts[y])
        own = known.filter(F.col("y") == y).orderBy(order, "id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = chosen.withColumn("use", F.pmod(F.xxhash64(F.lit("use"), "id"), F.lit(2)))
    picked = {r["id"]: (r["y"], r["use"]) for r in rows.collect()}
    wanted = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    # an id in several rows gives one text, so that the sample stays bounded
    wanted = common.cut(wanted.join(F.broadcast(rows), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    picks = spark.sparkContext.broadcast(picked)

    def sample(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, ys, parts = [], [], []
        for key, body in zip(batch.column("id").to_pylist(), common.texts(batch.column("text"))):
            y, use = picks.value[key]
            if use == 0:
                own = list(pieces(body, piece))
                own = [own[i] for i in np.unique(np.linspace(0, len(own) - 1, pieces_per_doc).astype(int))] if own else []
                ids += [key] * len(own)
                ys += [y] * len(own)
                parts += own
        yield common.batch_of({"id": ids, "y": ys, "part": parts}, {"id": pa.int64(), "y": pa.int32(), "part": pa.binary()})

    got = common.map_arrow(wanted, sample, "id long, y int, part binary").collect()
    got = sorted(((r["y"], hashlib.blake2b(bytes(r["part"]), digest_size=8).digest(), bytes(r["part"])) for r in got))
    model = Model(*(dictionary([p for y, _, p in got if y == k], dictionary_size) for k in (1, 0)), 1.0, 0.0, piece)
    if not model.good or not model.bad:
        share = (counts[1] + 1) / (counts[0] + counts[1] + 2)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))), piece)
    scored = differences(wanted, model, "id", "text").toPandas()
    scored = scored[[picked[i][1] == 1 for i in scored["doc_id"]]].sort_values("doc_id")
    y = np.array([picked[i][0] for i in scored["doc_id"]], float)
    if len(set(y)) < 2:
        return Model(model.good, model.bad, 1.0, 0.0, piece)
    w = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    slope, offset = logistic(scored["difference"].to_numpy(), y, w / w.mean())
    return Model(model.good, model.bad, slope, offset, piece)


def differences(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, difference and score of every whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, tools = shared.value, shared.value.compressors()
        d = [m.difference(t, tools) for t in common.texts(batch.column("text"))]
        yield common.batch_of({"doc_id": batch.column("doc_id"), "difference": d, "score": [m.score(x) for x in d]}, {"difference": pa.float64(), "score": pa.float64()})

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return common.map_arrow(source, run, "doc_id long, difference double, score double")


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every document.

    Null and empty texts get the score of no difference. Repeated rows each get
    a row; an empty table gives an empty result; other columns are not read.
    """
    return differences(docs, model, doc_id, text).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents scored ``threshold`` or higher, with all their columns and no shuffle.

    Null and empty texts get the score of no difference; repeated rows stay repeated; an empty table gives an empty result.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, tools = shared.value, shared.value.compressors()
        yield batch.filter(pa.array([m.score(m.difference(t, tools)) >= threshold for t in common.texts(batch.column(at))], pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)
