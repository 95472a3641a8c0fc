"""LM scores, decontamination, line rules, sharding: against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wayloom.llm")

from wayloom.llm import common, decontamination, lattice, line_rules, queries, sharding  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, word string"


def frame(spark, texts, host="h"):
    """Documents with clashing extra columns; equal ids where a text is given twice with one."""
    return spark.createDataFrame([(i, t, "en", host, 0, 7, 8, "w") for i, t in texts], DOCS)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Same same SAME"), (5, "Same same SAME"), (None, "no id here"), (6, "x" * 30_000), (7, "a b " * 20_000), (8, "çà ß ñ İ 漢字 \x00   end")]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_word_hashes_tell_words_apart():
    text = b"  alpha beta\nalpha\x0bgamma "
    h, begin, end = common.word_hashes(text)
    assert [text[a:b] for a, b in zip(begin, end)] == text.split()
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    many = b" ".join(str(i).encode() for i in range(50_000))
    assert len(np.unique(common.word_hashes(many)[0])) == 50_000


def _segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in _segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def test_lattice_is_the_sum_over_all_segmentations():
    v = lattice.Vocabulary([(b"a", -1.0), (b"b", -2.0), (b"ab", -1.5), (b"ba", -2.5), (b"aba", -3.0)])
    rng = np.random.default_rng(0)
    first, later = np.log(rng.dirichlet(np.ones(len(v.pieces)))), np.log(rng.dirichlet(np.ones(len(v.pieces) + 1)))
    words = [b"a", b"abab", b"babab", b"zab", b"ab" * 120]
    got, uses = lattice.lattice(words, v, lattice.Weights(first, later), np.ones(len(words)))
    at = {p: i for i, p in enumerate(v.pieces)}
    for w, g in zip(words[:4], got):
        total = sum(math.exp(first[at[s[0]]] + sum(later[at[p]] for p in s[1:]) + later[-1]) for s in _segmentations(w, at))
        assert math.isclose(g, math.log(total), rel_tol=1e-9)
    assert math.isclose(uses[0].sum(), len(words), rel_tol=1e-9) and math.isclose(uses[1][-1], len(words), rel_tol=1e-9)


def test_text_score_is_the_sum_over_all_segmentations(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    rows = [(1, "the cat"), (2, "a cat sat"), (3, "zq the"), (4, None), (5, "no at"), (7, "The THE the at")]
    docs, known = frame(spark, rows), F.col("doc_id") < 5
    got = {r["doc_id"]: r["score"] for r in lattice.score(docs, known, path, frequent=3).collect()}
    model = lattice.learn(lattice.word_counts(docs, known), path)
    v = lattice.Vocabulary.from_sentencepiece(path)
    at, first, later = {p: i for i, p in enumerate(v.pieces)}, model.weights.first, model.weights.later
    assert math.isclose(model.end, 4.5 / 12)  # 4 ends among the 11 tokens of rows 1 to 4
    for i, t in rows:
        total = math.log(model.end)
        for w in low(t).split():  # known words, repeated words and unknown words alike
            every = (s for s in _segmentations("\u2581".encode() + w.encode(), at))
            total += math.log(1 - model.end) + math.log(sum(math.exp(first[at[s[0]]] + sum(later[at[p]] for p in s[1:]) + later[-1]) for s in every))
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-9)


def test_learning_raises_the_probability_of_what_is_learned(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    docs = frame(spark, [(i, "ouwhea thandable ertion " * (1 + i % 3)) for i in range(30)])
    mean = [lattice.score(docs, F.lit(True), path, rounds=n).agg(F.avg("score")).first()[0] for n in (0, 1, 3)]
    assert mean[0] < mean[1] < mean[2]


def test_scores_and_base(spark):
    rows = [(i, t) for i, t in EDGE if i is not None] + [(i, "the cat sat on the mat " * (i % 4)) for i in range(10, 40)]
    docs = frame(spark, rows)
    fold = common.remainder(F.col("doc_id"), 5)
    got = {}
    for r in lattice.score(docs, fold != 1, queries.vocabulary("piece_bpe_32k.model"), frequent=5).collect():
        got.setdefault(r["doc_id"], r)
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for i, t in rows}
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None])
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = got[i]
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(c[w] > 0 for w in t) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert lattice.score(docs, fold != 1, queries.vocabulary("piece_bpe_32k.model")).count() == len(rows)


def test_scores_of_nothing(spark):
    docs = frame(spark, EDGE)
    assert lattice.score(docs.limit(0), F.lit(True), queries.vocabulary("piece_bpe_32k.model")).collect() == []
    none = lattice.score(docs.filter("doc_id in (1, 4)"), F.lit(False), queries.vocabulary("piece_bpe_32k.model")).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(r["score"] < 0 for r in none)


def _windows(items, size=10):
    out = {}
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            out.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    return out


@pytest.mark.parametrize("block_items", [20_000, 2])
def test_decontamination_against_brute_force(spark, block_items):
    rng = np.random.default_rng(5)
    vocab = ["aa", "bb", "cc", "Dd", "été"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, say(int(rng.integers(1, 25)))) for i in range(8)] + [(9, None), (10, "...") ] + [(11, "aa, BB")]
    items += [(12, items[0][1])]
    rows = EDGE + [(100 + i, say(60) + "; " + (items[i % 8][1]).upper().replace(" ", "--") + " " + say(9)) for i in range(20)]
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination.report(docs, bench, block_items=block_items).fillna({"doc_id": -5}).collect())
    wins = _windows(items)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        hit, found = set(), set()
        for m in {len(k) for k in wins}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found |= wins[tuple(w[k : k + m])]
        want.append((-5 if i is None else i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    kept = decontamination.decontaminate(docs, bench, block_items=block_items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not x[-1] for x in want)
    unnamed = spark.createDataFrame([(None, "x" * 30_000)], "item_id long, text string")
    assert {(r["doc_id"], r["n_items"], r["items_sha256"]) for r in decontamination.report(docs, unnamed).filter("contaminated").collect()} == {(6, 1, hashlib.sha256(b"").hexdigest())}
    assert decontamination.report(docs.limit(0), bench).count() == 0
    assert decontamination.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_line_rules(spark):
    spam = "buy now best offer of the whole long year " * 2
    body = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(6))
    rows = EDGE + [(100 + i, f"{spam}\n{body(i)}") for i in range(30)] + [(200 + i, "\n".join([f"Buy NOW best offer of the  whole long year {i % 10}"] * 1 + [spam] * 6 + [body(i)[:40]])) for i in range(30)]
    rows += [(300 + i, body(999)) for i in range(40)] + [(400, "\n".join(" ".join("k" + a + b for a in "abcdefghijkl") for b in "mnopqr"))] * 40
    got = {}
    limits = {"min_docs": 20, "share": 0.01}
    for r in line_rules.line_rules(frame(spark, rows), **limits).collect():
        got.setdefault(r["doc_id"], r)
    assert all(got[100 + i]["kept"] and got[100 + i]["n_removed_words"] == 18 for i in range(30))
    assert not any(got[200 + i]["kept"] for i in range(30))
    assert all(not got[300 + i]["kept"] and got[300 + i]["n_removed_words"] == 72 for i in range(40)), "documents count, not texts"
    assert got[400]["n_removed_words"] == 0 and got[400]["kept"], "repeated rows are one document"
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and not got[1]["kept"]
    for i, t in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        marked = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked))
    again = {r["doc_id"]: r["kept"] for r in line_rules.line_rules(frame(spark, rows), broadcast_rows=0, **limits).collect()}
    assert all(again[k] == v["kept"] for k, v in got.items())
    assert line_rules.line_rules(frame(spark, EDGE).limit(0)).count() == 0
    assert line_rules.line_rules(frame(spark, EDGE, None)).count() == len(EDGE)


def test_line_limits(spark):
    """A line on exactly the limit stays, one document more takes it out; hosts and null hosts count apart; too few words left is depleted."""
    own = lambda i, n=60: " ".join(f"{chr(97 + i)}w{k}" for k in range(n))
    rows = [(i, f"Line A 1\n{own(i)}", "x") for i in range(5)] + [(10 + i, f"line  a 2\n{own(10 + i)}", "y") for i in range(6)] + [(20 + i, f"line a 3\n{own(20 + i, 48 + i)}", None) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_rules.line_rules(docs).collect()}
    assert all(got[i]["n_removed_words"] == 0 and got[i]["kept"] for i in range(5))
    assert all(got[10 + i]["n_removed_words"] == 3 and got[10 + i]["kept"] for i in range(6))
    assert [got[20 + i]["kept"] for i in range(6)] == [False, False, True, True, True, True] and not any(got[20 + i]["base_failed"] for i in range(6))
    assert all(r["n_removed_words"] == 0 for r in line_rules.line_rules(docs, share=1.0).collect())


def _jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_shards(spark):
    keys = [0, 1, -1, 7, 2**62, -(2**63), 2**63 - 1, *range(100, 1500)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 40):
        got = df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()
        assert all(r["s"] == _jump(r["k"], n) for r in got)


def test_sharding(spark):
    rows = EDGE + [(100 + i, "t" * (i % 17)) for i in range(500)]
    got = sharding.shard(frame(spark, rows), rows_per_bucket=40).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {i: t or "" for i, t in rows}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    assert sharding.shard(frame(spark, rows).limit(0)).count() == 0
    named = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    by_name = sharding.shard(named).withColumn("again", sharding.jump_shard(F.xxhash64("doc_id"), 8)).collect()
    assert len(by_name) == len(rows) and all(r["shard"] == r["again"] for r in by_name if r["doc_id"]) and len({r["shard"] for r in by_name}) == 8
    plan = sharding.shard(frame(spark, rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_every_learning_round_sees_all_words(spark):
    rng, letters = np.random.default_rng(2), np.frombuffer(b"abcdefghijklmnop", np.uint8)
    words = sorted({bytes(w) for w in letters[rng.integers(0, len(letters), (320_000, 5))]})[:200_500]
    assert len(words) > 200_000
    path = queries.vocabulary("piece_bpe_32k.model")
    counts = spark.createDataFrame(pd.DataFrame({"word": words, "c": 1, "c_all": 1}), "word binary, c long, c_all long")
    model = lattice.learn(counts.repartition(8), path)
    v = lattice.Vocabulary.from_sentencepiece(path)
    weights, body = lattice.Weights.prior(v), [lattice.WORD_START + w for w in words]
    for _ in range(5):
        first, later = (u + 0.01 for u in lattice.lattice(body, v, weights, np.ones(len(body)))[1])
        weights = lattice.Weights(np.log(first / first.sum()), np.log(later / later.sum()))
    assert np.allclose(model.weights.first, weights.first, atol=1e-6) and np.allclose(model.weights.later, weights.later, atol=1e-6)
