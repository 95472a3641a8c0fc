"""Language-model scores of texts: the marginal over all subword segmentations of their words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: What stands before each word in the vocabulary's pieces.
WORD_START = "▁".encode()

#: The token that ends each document, in counts; no word holds a space.
END = b" "


class Vocabulary:
    """The pieces of a subword vocabulary, as bytes with their scores.

    Every single byte is a piece, so that each text has a segmentation. Pieces
    are found by a hash of their bytes: a bit table rules out nearly all other
    strings, a sorted search confirms the rest. ``ranked``: the scores are no log
    probabilities but ranks (0, -1, -2 ...), as a merge vocabulary has them.
    """

    def __init__(self, pieces: list[tuple[bytes, float]], ranked: bool = False):
        self.ranked = ranked
        best: dict[bytes, float] = {}
        for piece, score in pieces:
            if piece:
                best[piece] = max(best.get(piece, -np.inf), score)
        least = min(best.values(), default=0.0)
        for b in range(256):
            best.setdefault(bytes([b]), least)
        self.pieces = sorted(best)
        self.scores = np.array([best[p] for p in self.pieces])
        self.lengths = sorted(set(map(len, self.pieces)))
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self.bits = np.zeros(1 << 22, bool)
        self.bits[hashes & np.uint64((1 << 22) - 1)] = True

    @staticmethod
    def _hash(piece: bytes) -> np.uint64:
        raw = np.frombuffer(piece, np.uint8)
        total = (common._BYTE[raw] * common._powers(len(raw))).sum(dtype=np.uint64)
        return common.mix(np.array([total + np.uint64(len(raw))], np.uint64))[0]

    def find(self, sums: np.ndarray, length: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of strings of ``length`` bytes with these raw sums, ``rows`` to a place: place, row and piece of those that are pieces."""
        h = common.mix(sums + np.uint64(length))
        maybe = np.flatnonzero(self.bits[h & np.uint64((1 << 22) - 1)])
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        ok = self.sorted[at] == h[maybe]
        hit = maybe[ok]
        return hit // rows, hit % rows, self.order[at[ok]]

    @classmethod
    def from_sentencepiece(cls, path: str, ranked: bool = True) -> Vocabulary:
        """Pieces and scores of a SentencePiece file; byte pieces stand for their byte, control pieces go.

        ``ranked`` holds for files of its BPE kind, not of its unigram kind.
        """
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        for i in range(tool.get_piece_size()):
            if tool.is_control(i) or tool.is_unknown(i) or tool.is_unused(i):
                continue
            name = tool.id_to_piece(i)
            pieces.append((bytes([int(name[3:5], 16)]) if tool.is_byte(i) else name.encode(), tool.get_score(i)))
        return cls(pieces, ranked)

    def prior(self) -> np.ndarray:
        """Log probabilities from the scores, normalised; scores that are ranks (``ranked``) count under Zipf's law."""
        s = self.scores
        if self.ranked:
            s = -np.log(10.0 + s.max() - s)
        return s - np.logaddexp.reduce(s)


@dataclass
class Weights:
    """Log probabilities (natural) of the pieces: as first of a word, and as a later one.

    The last of the later ones is the end of the word.
    """

    first: np.ndarray
    later: np.ndarray

    @classmethod
    def prior(cls, vocabulary: Vocabulary) -> Weights:
        p = vocabulary.prior()
        return cls(p, np.append(p, 0.0) - np.log(2.0))


#: Words of more bytes are walked one by one.
LONG_WORD = 200


def lattice(words: list[bytes], vocabulary: Vocabulary, weights: Weights, times: np.ndarray | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """Log marginal of each word, and the expected uses of each piece if ``times`` are given.

    Words of equal length go together: alpha[i], the log of the summed
    probability of all segmentations of the first i bytes, is the log-sum over
    the pieces that end there. With ``times``, how often each word counts, the
    backward recursion gives each piece's posterior uses, first and later.
    """
    out = np.zeros(len(words))
    uses = None if times is None else (np.zeros(len(weights.first)), np.zeros(len(weights.later)))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, members in by_length.items():
        if not n:
            continue
        most = 1 if n > LONG_WORD else max(1, (1 << 19) // n)
        for at in range(0, len(members), most):
            own = np.array(members[at : at + most])
            x = np.frombuffer(b"".join(words[k] for k in own), np.uint8).reshape(len(own), n)
            found = _matches(x, vocabulary)
            alpha = np.full((n + 1, len(own)), -np.inf)
            alpha[0] = 0.0
            for end in range(1, n + 1):
                values = [alpha[end - length, rows] + (weights.later if end > length else weights.first)[piece] for length, rows, piece in found[end]]
                top = np.full(len(own), -np.inf)
                for (_, rows, _), v in zip(found[end], values):
                    top[rows] = np.maximum(top[rows], v)
                total = np.zeros(len(own))
                for (_, rows, _), v in zip(found[end], values):
                    total[rows] += np.exp(v - top[rows])
                alpha[end] = top + np.log(total)
            out[own] = alpha[n] + weights.later[-1]
            if uses is not None:
                beta = np.full((n + 1, len(own)), -np.inf)
                beta[n] = 0.0
                for end in range(n, 0, -1):
                    for length, rows, piece in found[end]:
                        first = end == length
                        v = beta[end, rows] + (weights.first if first else weights.later)[piece]
                        beta[end - length, rows] = np.logaddexp(beta[end - length, rows], v)
                        use = np.exp(alpha[end - length, rows] + v - alpha[n, rows]) * times[own[rows]]
                        np.add.at(uses[0 if first else 1], piece, use)
                uses[1][-1] += times[own].sum()
    return out, uses


def _matches(x: np.ndarray, vocabulary: Vocabulary) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each end, the lengths of pieces that end there, with the rows that have them and the pieces."""
    rows, n = x.shape
    sums = np.zeros((rows, n + 1), np.uint64)
    np.cumsum(common._BYTE[x] * common._powers(n)[None, :], axis=1, dtype=np.uint64, out=sums[:, 1:])
    inverse = common._inverses(n)
    found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
    for length in vocabulary.lengths:
        if length > n:
            break
        part = (sums[:, length:] - sums[:, : n + 1 - length]) * inverse[None, : n + 1 - length]
        at, row, piece = vocabulary.find(part.T.ravel(), length, rows)
        if len(at):
            edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            for a, b in zip(edges[:-1], edges[1:]):
                found[int(at[a]) + length].append((length, row[a:b], piece[a:b]))
    return found


@dataclass
class Model:
    """A text's probability: of each word, (1 - ``end``) times its marginal over all segmentations; of its end, ``end``."""

    weights: Weights
    end: float

    def log_probability(self, words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
        """Natural logs for ``words``; END stands for the end."""
        is_end = np.array([w == END for w in words], bool)
        marginal, _ = lattice([b"" if w == END else WORD_START + w for w in words], vocabulary, self.weights)
        return np.where(is_end, np.log(self.end), marginal + np.log(1 - self.end))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Neighbouring batches put together, as vectorised steps want many words."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _vocabulary(path: str, cache: dict[str, Vocabulary] = {}) -> Vocabulary:  # noqa: B006
    if path not in cache:
        cache[path] = Vocabulary.from_sentencepiece(path)
    return cache[path]


def word_counts(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", held: int = 400_000) -> DataFrame:
    """word (binary), c (uses in training documents) and c_all of every word, and of END once a document.

    Each task sums what it reads, at most ``held`` words at a time, before the shuffle.
    """
    source = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for k in (0, 1):
                words = list(both[k])
                n = np.fromiter(both[k].values(), np.int64, len(words))
                for at in range(0, len(words), 50_000):
                    part = n[at : at + 50_000]
                    yield common.batch_of({"word": words[at : at + 50_000], "c": part * k, "c_all": part}, {"word": pa.binary()})
                both[k].clear()

        for batch in common.sliced(batches):
            for body, learn in zip(common.texts(batch.column("text")), batch.column("train").to_pylist()):
                own = both[1 if learn else 0]
                own.update(body.lower().split())
                own[END] += 1
                if len(own) > held:
                    yield from flush()
        yield from flush()

    return source.mapInArrow(run, "word binary, c long, c_all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def learn(counts: DataFrame, path: str, rounds: int = 5, smoothing: float = 0.01, end: float = 0.01) -> Model:
    """The model of the words counted in training.

    Piece weights by expectation maximisation: the vocabulary's own scores weight
    all segmentations in the first round, the learned weights in the later ones,
    and a word counts as often as it occurs. Each of the ``rounds`` goes over all
    distinct training words, whatever their number; each task sums its words'
    expected piece uses, and the driver gets one sum per piece of the vocabulary.
    The probability of the end is its share of the training tokens; ``end`` if there are none.
    """
    spark = counts.sparkSession
    vocabulary = _vocabulary(path)
    trained = counts.filter("c > 0")
    facts = trained.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    words = trained.filter(F.col("word") != F.lit(END)).select("word", "c")
    weights = Weights.prior(vocabulary)
    for _ in range(rounds if facts["n"] else 0):
        shared = spark.sparkContext.broadcast(weights)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary = _vocabulary(path)
            total = np.zeros(2 * len(shared.value.first) + 1)
            for part in gathered(batches):
                body = [WORD_START + w for w in part.column("word").to_pylist()]
                total += np.concatenate(lattice(body, vocabulary, shared.value, part.column("c").to_numpy().astype(float))[1])
            at = np.flatnonzero(total)
            yield common.batch_of({"piece": at.astype(np.int32), "uses": total[at]})

        uses = np.full(2 * len(weights.first) + 1, smoothing)
        for r in words.mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"]] += r["uses"]
        first, later = np.split(uses, [len(weights.first)])
        weights = Weights(np.log(first / first.sum()), np.log(later / later.sum()))
    if facts["n"]:
        end = ((facts["ends"] or 0) + 0.5) / (facts["n"] + 1)
    return Model(weights, end)


def score(docs: DataFrame, train: Column, path: str, doc_id: str = "doc_id", text: str = "text", rounds: int = 5, frequent: int = 100_000) -> DataFrame:
    """Score every text by a model learned from the rows where ``train`` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score, both
    log10. Tokens are the lower-cased white-space words and one end. The base is a
    smoothed word unigram. The score is the marginal probability of the text over
    all segmentations of all its words, known or not, into vocabulary pieces
    (``Model``). No piece spans two words, so the text's forward recursion is the
    sum of its words'; each distinct word of the corpus goes through the lattice
    once.

    Words with at least 1 in ``frequent`` of all tokens - at most ``frequent`` of
    them, whatever the corpus - are broadcast and summed where the text is read;
    the others are joined by word. A null text is empty: its one token is the end.
    Repeated rows each get a row; an empty table gives an empty result; with
    nothing to learn from, all counts are 0 and the vocabulary's scores are used.
    """
    spark = docs.sparkSession
    counts = common.cut(word_counts(docs, train, doc_id, text))
    sums = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("c_all").alias("all")).first()
    n, v, n_all = sums["n"] or 0, sums["v"] or 0, sums["all"] or 0
    model = learn(counts, path, rounds)
    log_total = float(np.log10(n + 0.5 * (v + 1)))
    shared = spark.sparkContext.broadcast(model)
    ln10 = float(np.log(10.0))

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in gathered(batches):
            words = part.column("word").to_pylist()
            own = m.log_probability(words, _vocabulary(path)) / ln10
            yield common.batch_of({"word": part.column("word").combine_chunks(), "c": part.column("c").to_numpy(), "c_all": part.column("c_all").to_numpy(), "score": own})

    scored = common.cut(counts.mapInArrow(word_scores, "word binary, c long, c_all long, score double"))
    frequent_rows = scored.filter(F.col("c_all") * frequent >= n_all).toLocalIterator()
    hot = spark.sparkContext.broadcast({bytes(r["word"]): (int(r["c"] > 0), float(np.log10(r["c"] + 0.5)) - log_total, r["score"]) for r in frequent_rows})
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("row", F.monotonically_increasing_id())

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = hot.value
        rare: tuple[list, ...] = ([], [], [])
        whole: tuple[list, ...] = ([], [], [], [], [], [])
        for row, key, body in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), common.texts(batch.column("text"))):
            own = Counter(body.lower().split())
            own[END] += 1
            k = b = s = 0
            for w, t in own.items():
                got = known.get(w)
                if got is None:
                    for x, y in zip(rare, (row, w, t)):
                        x.append(y)
                else:
                    k, b, s = k + got[0] * t, b + got[1] * t, s + got[2] * t
            for x, y in zip(whole, (row, key, own.total(), k, b, s)):
                x.append(y)
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "word": pa.binary(), "times": pa.int64(), "tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "own": pa.float64()}
        none = [None] * len(rare[0])
        yield common.batch_of({"row": rare[0], "doc_id": none, "word": rare[1], "times": rare[2], "tokens": none, "known": none, "base": none, "own": none}, kinds)
        # a document's own row joins no word: a space and its number keep such rows spread
        apart = [b" " + str(r).encode() for r in whole[0]]
        yield common.batch_of({"row": whole[0], "doc_id": whole[1], "word": apart, "times": [0] * len(apart), "tokens": whole[2], "known": whole[3], "base": whole[4], "own": whole[5]}, kinds)

    parts = common.map_arrow(source, split, "row long, doc_id long, word binary, times long, tokens long, known long, base double, own double")
    table = scored.select(F.col("word").alias("t_word"), F.col("c").alias("t_c"), F.col("score").alias("t_score")).filter(F.col("c_all") * frequent < n_all)
    joined = parts.join(table, parts["word"] == table["t_word"], "left")
    times = F.col("times")
    base = F.coalesce("base", times * (F.log10(F.coalesce("t_c", F.lit(0)) + F.lit(0.5)) - F.lit(log_total)))
    own = F.coalesce("own", times * F.col("t_score"))
    n_known = F.coalesce("known", F.when(F.col("t_c") > 0, times).otherwise(0))
    out = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("tokens").alias("n_tokens"), F.sum(n_known).alias("n_known"), F.sum(base).alias("base_score"), F.sum(own).alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
