"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Result for texts that are null or have no letter.
UNDETERMINED = "und"


def ngrams(text: str, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """Bucket of every character n-gram of the lower-cased text, white space runs as one space."""
    body = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in orders:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        out.append(h & np.uint32(buckets - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def tf_idf(text: str, orders: tuple[int, ...], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the text's n-grams fall in and their weights, of length 1 together."""
    own = ngrams(text, orders, len(idf))
    if 4 * len(own) < len(idf):
        at, n = np.unique(own, return_counts=True)
    else:
        n = np.bincount(own, minlength=len(idf))
        at = np.flatnonzero(n)
        n = n[at]
    v = n * idf[at]
    return at, v / (np.sqrt(v @ v) or 1.0)


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float
    orders: tuple[int, ...]

    def logits(self, text: str) -> np.ndarray:
        at, v = tf_idf(text, self.orders, self.idf)
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.classes or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.classes[k], float(p[k] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, buckets: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights by follow-the-regularised-leader with elastic-net penalties; the last row is the bias."""
    z, n = np.zeros((buckets + 1, n_classes)), np.zeros((buckets + 1, n_classes))

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for idx, val, y in rows:
            i, x = np.append(idx, buckets), np.append(val, 1.0)
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(buckets + 1))


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The divisor of the logits that gives held-back rows the highest (weighted) likelihood."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.average(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y], weights=weight))

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    docs: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 750,
    orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3,
) -> Model:
    """Learn from the rows that ``train`` (over the id column) admits and whose language is not null.

    Document frequencies for the inverse weights count every such row, and every
    language among them is a class. Weights and temperature come from a bounded
    sample: of each language at most ``sample`` documents, in hash order of their
    ids, a fifth of which calibrates. The sample is even where the corpus is not; the
    bias gets the difference of the logarithms of both shares, and the held-back rows
    weigh accordingly. An id in several rows gives one. With no row to learn
    from, every text is undetermined.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    if train is not None:
        rows = rows.filter(train)
    rows = rows.filter("lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes, total = sorted(counts), sum(counts.values())
    if not classes:
        return Model([], np.ones(buckets), np.zeros((buckets, 0)), np.zeros(0), 1.0, orders)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                own = ngrams(t or "", orders, buckets)
                if 4 * len(own) < buckets:
                    df[np.unique(own)] += 1
                else:
                    df += np.bincount(own, minlength=buckets) > 0
        at = np.flatnonzero(df)
        yield common.batch_of({"bucket": at.astype(np.int32), "df": df[at]})

    counted = rows.select("text").mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(buckets)
    df[counted["bucket"].to_numpy()] = counted["df"].to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1
    shared = spark.sparkContext.broadcast((idf, {c: i for i, c in enumerate(classes)}))

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own_idf, index = shared.value
        out = []
        for key, t, c in zip(*(batch.column(k).to_pylist() for k in ("id", "text", "lang"))):
            at, v = tf_idf(t or "", orders, own_idf)
            out.append((key, at.astype(np.int32).tobytes(), v.astype(np.float32).tobytes(), index[c]))
        ids, a, v, y = zip(*out) if out else ((), (), (), ())
        yield common.batch_of({"id": list(ids), "at": list(a), "v": list(v), "y": list(y)}, {"id": pa.int64(), "at": pa.binary(), "v": pa.binary(), "y": pa.int32()})

    # a threshold on the hash keeps a few more than wanted of each language, so that the ranking sees few rows
    spot = F.xxhash64(F.lit("lang"), "id")
    share = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, 2.0 * sample / n)))[F.col("lang")]
    near = rows.filter(F.col("id").isNotNull() & (F.pmod(spot, F.lit(1 << 40)) < share * F.lit(1 << 40))).select("lang", "id").distinct()
    chosen = near.withColumn("h", spot).selectExpr("lang", "id", "row_number() over (partition by lang order by h, id) as r").filter(F.col("r") <= sample)
    chosen = chosen.groupBy("id").agg(F.min("lang").alias("lang"))
    picked = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    got = common.map_arrow(picked, features, "id long, at binary, v binary, y int")

    def train_one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(o=common.mix(frame["id"].to_numpy().astype(np.int64).view(np.uint64))).sort_values(["o", "id", "y"])
        data = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(float), int(y)) for a, v, y in zip(frame["at"], frame["v"], frame["y"])]
        back = len(data) // 5
        w = ftrl(data[back:] or data, len(classes), buckets, alpha, beta, l1, l2, epochs)
        seen = np.bincount([y for *_, y in data], minlength=len(classes)) / len(data)
        true = np.array([counts[c] for c in classes]) / total
        w[-1] += np.log(true / np.maximum(seen, 1e-9)).clip(-10, 10)
        logits = np.array([v @ w[a] + w[-1] for a, v, _ in data[:back]])
        y = np.array([y for *_, y in data[:back]], int)
        t = temperature(logits, y, (true / np.maximum(seen, 1e-9))[y]) if back else 1.0
        return pd.DataFrame({"w": [w.astype(np.float64).tobytes()], "t": [t]})

    made = got.groupBy(F.lit(1).alias("g")).applyInPandas(train_one, "w binary, t double").collect()
    if not made:
        return Model([], idf, np.zeros((buckets, 0)), np.zeros(0), 1.0, orders)
    w = np.frombuffer(bytes(made[0]["w"]), np.float64).reshape(buckets + 1, len(classes))
    return Model(classes, idf, w[:-1], w[-1], made[0]["t"], orders)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (calibrated probability) of every whole text.

    A text that is null or has no letter gets ``und`` with score 0. Repeated rows
    each get a row; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        yield common.batch_of({"doc_id": batch.column("doc_id"), "lang_pred": [a for a, _ in got], "score": [b for _, b in got]}, {"lang_pred": pa.string(), "score": pa.float64()})

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return common.map_arrow(source, run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The documents whose language is determined with ``min_score`` or more, with all their columns and no shuffle.

    Texts that are null or have no letter go; repeated rows stay repeated; an empty table gives an empty result.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
        yield batch.filter(pa.array([c != UNDETERMINED and p >= min_score for c, p in got], pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)
