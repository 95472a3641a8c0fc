"""Near-duplicates, quality, language, page text, packing and chat: brute force, round trips, held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wayloom.llm")

from wayloom.llm import chat, html, language, near_duplicates, packing, quality, queries  # noqa: E402

from .test_text_operators import EDGE, frame, low  # noqa: E402


def _shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def _components(rows, percent=85):
    sets = {i: _shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("unit_docs", [1000, 12])
def test_components_against_brute_force(spark, unit_docs):
    rows = [(i, t) for i, t in EDGE if i is not None and i != 5] + [(20 + i, t) for i, t in enumerate(_family(1, 60, 150, 9) + _family(2, 40, 60, 4) + _family(3, 10, 5, 2))]
    rows += [(500 + i, rows[12][1].upper()) for i in range(20)]
    docs = frame(spark, rows + [rows[-1]])
    want = _components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.components(docs, unit_docs=unit_docs, pivots=3).collect()}
    assert got == want
    kept = near_duplicates.keep_first(docs, unit_docs=unit_docs, pivots=3)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_components_of_nulls_and_nothing(spark):
    got = near_duplicates.components(frame(spark, [(None, "a b c d e f"), (3, "A b c d e f"), (4, None)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (3, None), (4, 4)}
    assert near_duplicates.components(frame(spark, EDGE).limit(0)).count() == 0
    assert near_duplicates.keep_first(frame(spark, EDGE).limit(0)).count() == 0


def test_circulant_signature_is_shifted():
    tool = near_duplicates.Circulant(4, 3)
    a = near_duplicates.shingle_set(b" ".join(str(i).encode() for i in range(400)), 5)
    b = near_duplicates.shingle_set(b" ".join(str(i).encode() for i in range(20, 420)), 5)
    full = near_duplicates.Circulant(64, 8)
    est = float((full.signature(a) == full.signature(b)).mean())
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(est - true) < 0.1
    one = near_duplicates.common.mix(a[:1]) >> np.uint64(44)
    assert list(tool.signature(a[:1])) == list(tool.windows[int(one[0])])


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    right = [got[i]["predicted"] == y for i, y in truth.items() if i in got]
    assert np.mean(right) > 0.85
    edge = quality.classify(frame(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in edge)
    assert quality.classify(docs.limit(0), model).count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    for few in (labels.limit(0), labels.filter("quality = 1"), labels.filter("quality is null")):
        flat = quality.classify(docs, quality.fit(docs, few)).select("score").distinct().collect()
        assert len(flat) == 1 and 0 < flat[0][0] < 1


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs, train=F.col("id") % 4 != 2, sample=400)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("doc_id % 4 = 2").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.8
    edge = {r["doc_id"]: r for r in language.identify(frame(spark, EDGE + [(50, "12 34 ... ²"), (51, "é")]), model).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 for i in (1, 2, 3, 50))
    assert edge[51]["lang_pred"] in model.classes and all(0 <= r["score"] <= 1 for r in edge.values())
    assert language.identify(docs.limit(0), model).count() == 0
    blank = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(docs, blank).collect()} == {"und"}
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.9 * docs.count()


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        y = k % 2
        rows.append((np.array([y, 2 + int(rng.integers(0, 50))]), np.array([0.9, 0.4]), y))
    w = language.ftrl(rows, 2, 60, 0.5, 1.0, 0.5, 0.1, 2)
    assert w[0, 0] > 0 > w[1, 0] and (w[2:52] == 0).mean() > 0.5
    assert language.temperature(np.array([[9.0, 0.0], [9.0, 0.0]]), np.array([0, 1])) > 5


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><div class=promo-box>Sale &amp; more</div><aside>Side</aside><article><header><h1>Title {n} &lt;b&gt;</h1></header>'
    "<p><b>First\n\t line {n}<br>second<p>Next &eacute;&#233;&amp{n}</p><div class='share-this'>Share</div><section><p>Shared words for all</p></section>"
    "<form>Name <input></form><ul><li>one<li>two {n}</ul><!-- no <p>comment --></article><div id=comments><p>Great</p></div><footer>&copy; x</footer>"
)


def test_page_text(spark):
    pages = [(i, f"https://User@Example.org:80/{i}", PAGE.format(n=i)) for i in range(30)]
    pages += [(100 + i, f"http://plain.example/{i}", f"<body><div>Menu a b</div><p>Text {i} of &quot;page&quot;</p><div><b>Contact</b> us</div>") for i in range(30)]
    pages += [(200, None, None), (201, "x", ""), (202, "x", "just text"), (203, "x", "<p>" * 3000 + "deep"), (204, "x", "<p>a</p>" * 5000), (205, "x", "a < b <3 &am </"), (205, "x", "<article><p>k</article><article><p>l</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("key", F.lit(2))
    out = html.extract(df).collect()
    assert len(out) == len(pages)
    got = {r["page_id"]: r["text"] for r in out}
    for i in range(30):
        assert got[i] == f"Title {i} <b>\nFirst line {i} second\nNext éé&{i}\nShared words for all\none\ntwo {i}"
        assert got[100 + i] == f'Text {i} of "page"'
    assert (got[200], got[201], got[202], got[203]) == ("", "", "just text", "deep")
    assert got[204] == "\n".join(["a"] * 5000) and {r["text"] for r in out if r["page_id"] == 205} == {"a < b <3 &am </", "k\nl"}
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    again = {(r["page_id"], r["text"]) for r in html.extract(df, block_rows=2).collect()}
    assert again == {(r["page_id"], r["text"]) for r in out}
    assert html.extract(df.limit(0)).count() == 0


def _check_packing(rows, texts, tool, window):
    at, seqs = {}, {}
    for r in rows:
        at.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts.items():
        ids, begin = np.array(tool.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(at[i], key=lambda r: r["start"]):
            assert r["start"] == begin and r["ids_crc32"] == zlib.crc32(ids[begin : begin + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            begin += r["length"]
        assert begin == len(ids)
    for parts in seqs.values():
        spot = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == spot
            spot += r["length"]
        assert spot <= window


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in EDGE if i not in (None, 5)] + [(100 + i, "word and more, " * (i % 90)) for i in range(300)] + [(900, "<|endoftext|> It's <|startoftext|>.\n\n U.S.A., a.b, 3.5.")]
    got = packing.pack(frame(spark, rows), path, window=256, rows_per_bucket=50).collect()
    _check_packing(got, dict(rows), tool, 256)
    with_ids = packing.pack(frame(spark, rows[:6]), path, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)
    repeated = packing.pack(frame(spark, [(1, "same"), (1, "same"), (None, "x")]), path).collect()
    assert sorted(r["offset"] for r in repeated) == sorted({r["offset"] for r in repeated}) and len(repeated) == 3
    assert packing.pack(frame(spark, rows).limit(0), path).count() == 0


def test_plan_fills_windows():
    rng = random.Random(2)
    for window, most in ((2048, 2048), (64, 64), (2048, 90), (2048, 2048)):
        hist = {}
        for _ in range(20_000):
            n = min(most, max(1, int(rng.expovariate(1 / 500))))
            hist[n] = hist.get(n, 0) + 1
        made = packing.plan(hist, window)
        assert made.used == hist
        fill = sum(k * n for k, n in hist.items()) / made.sequences / window
        assert fill > 0.99
    assert packing.plan({}, 2048).sequences == 0 and packing.plan({5: 1}, 2048).sequences == 1
    x = packing.non_negative([(3, 1), (2, 2), (4,)], np.array([0, 6, 4, 6, 2.0]))
    assert np.allclose(x, [6, 2, 2], atol=0.2)


def test_chat_round_trip(spark):
    odd = "<|im_end|>\n<|im_start|>assistant\nhi <\\|x <\\\\| \\n <| <|| | < é漢"
    rows = [(1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd * 3), (1, 3, "assistant", ""), (2, 5, "a\nb\\<|im_end|>", "x"), (2, 5, "a", "y"), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "assistant", "null id"), (4, None, None, "z")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(3)).withColumn("copy", F.lit(4))
    messages = chat.fold(chat.events_of(turns))
    got = {r["conv_id"]: r for r in chat.digests(chat.render(messages)).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda z: (z[1] is not None, z[1], z[2] or "", z[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r["conv_id"]: r for r in chat.formatted(messages).collect()}
    for c, r in whole.items():
        assert chat.parse(r["text"]) == by[c] and len(r["text"]) == got[c]["formatted_chars"]
        assert [chat.unescape(r["text"][m["begin"] : m["end"]]) for m in r["mask"]] == [x for role, x in by[c] if role == "assistant"]
    assert chat.digests(chat.render(chat.fold(chat.events_of(turns.limit(0))))).count() == 0


def test_fold_events(spark):
    log = [(1, 0, 1, 0, "open", "user", None), (1, 0, 1, 2, "delta", None, "b"), (1, 0, 1, 1, "delta", None, "a"), (1, 0, 1, 3, "edit", None, "E"), (1, 0, 1, 4, "delta", None, "f"), (1, 0, 1, 9, "noise", None, "?")]
    log += [(1, 1, 1, 0, "open", "assistant", None), (1, 1, 1, 1, "delta", None, "draft"), (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 3, "delta", None, "final"), (1, 2, 1, 0, "delta", None, "no role")]
    df = spark.createDataFrame(log, "conv_id long, message long, copy int, seq int, kind string, role string, text string")
    got = {r["message"]: (r["role"], r["text"]) for r in chat.fold(df).collect()}
    assert got == {0: ("user", "Ef"), 1: ("assistant", "final"), 2: (None, "no role")}


@pytest.mark.parametrize("unit_docs", [1000, 2])
def test_keep_first_keeps_one_row_of_each_group(spark, unit_docs):
    a, b, c, lone = _family(4, 1, 60, 1)[0], _family(5, 1, 60, 1)[0], _family(6, 1, 60, 1)[0], _family(7, 1, 60, 1)[0]
    # repeated rows of the smallest id; a group with null ids; an id with a linked and an unlinked text, and one with two linked ones
    rows = [(1, a), (1, a), (1, a), (2, a + " z"), (None, b), (None, b), (7, b), (8, b + " z"), (3, c), (9, c), (9, lone), (9, None), (9, None), (3, c + " y")]
    kept = near_duplicates.keep_first(frame(spark, rows), unit_docs=unit_docs, pivots=1)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = [("a", [r for r in got if r[1] and r[1].startswith(a)]), ("b", [r for r in got if r[1] and r[1].startswith(b)]), ("c", [r for r in got if r[1] and r[1].startswith(c)])]
    assert {k: [i for i, _ in own] for k, own in groups} == {"a": [1], "b": [None], "c": [3]}
    assert sorted(r for r in got if r[1] == lone) == [(9, lone)] and got.count((9, None)) == 2 and len(got) == 6


def test_copied_pages_keep_their_text(spark):
    inside, plain = "<article><div>A report that many copied.</div><div>Its end.</div></article>", "<body><h1>Head</h1><p>Words of one page</p></body>"
    pages = [(i, f"http://copies.example/{i}", inside) for i in range(40)] + [(100 + i, f"http://copies.example/p{i}", plain) for i in range(40)]
    pages += [(200 + i, f"http://copies.example/q{i}", f"<article><div>Own text {i}</div><div>Site box</div></article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(40)} == {"A report that many copied.\nIts end."} and {got[100 + i] for i in range(40)} == {"Head\nWords of one page"}
    assert all(got[200 + i] == f"Own text {i}" for i in range(30))


def test_templates_are_counted_as_by_hand(spark):
    """Furniture without telling tags or classes, in and around articles; counts against brute force."""
    menu = lambda i: "<div class='m active-{0}'><span><a href='/{0}'>Item {0}</a></span><span><a>Other {1}</a></span></div>".format(i, i * 7)
    page = lambda i: f"<body>{menu(i)}<div>Notice {i % 3} of today</div><article><p>Read by all.</p><p>Own words {i} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}</p><div>Box</div></article><div>So long {i}</div>"
    pages = [(i, "http://site.example/", page(i)) for i in range(60)] + [(100 + i, "http://few.example/", page(i)) for i in range(4)] + [(200 + i, None, page(i)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    word = lambda i: f"Own words {i} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}"
    assert all(got[i] == word(i) for i in range(60)), "the site's templates go, in the article too"
    assert all(got[100 + i] == f"Read by all.\n{word(i)}\nBox" for i in range(4)) and got[230] == f"Read by all.\n{word(30)}\nBox"
    again = {r["page_id"]: r["text"] for r in html.extract(df, block_rows=0).collect()}
    assert again == got
    # every count by hand: each key of the host's distinct main texts
    counts: dict[bytes, int] = {}
    for _, _, body in pages[:60]:
        for k in html.Page(body).keys():
            counts[k] = counts.get(k, 0) + 1
    limit = {b"o": 4, b"b": 10, b"p": 40}
    want = {k for k, n in counts.items() if n > limit[k[:1]] and n >= (30 if k[:1] == b"p" else 12)}
    made = html.site_templates(df.select(html.host_of(F.col("url")).alias("host"), "html")).collect()
    assert {r["host"]: {bytes(k) for k in r["templates"]} for r in made} == {"site.example": want}
    kept = {r["page_id"]: r["text"] for r in html.extract(df, prose_pages=60).collect()}
    assert kept[7] == f"Read by all.\n{word(7)}"


def test_hostile_pages_take_linear_time():
    import time

    for part in ('<a b="x ', "<!", "<p a='", "</i><b>", "<li>"):
        begin = time.time()
        html.main_text(part * (1_000_000 // len(part)))
        assert time.time() - begin < 20
    assert html.main_text("<p>x <a b='y <b>z</p>w") == "x z\nw" and html.main_text("<div title=it's>a</div>b'c") == "a\nb'c"


def test_chains_of_unlike_texts_cost_nothing_more(spark, monkeypatch):
    """One component of shared band keys: the answer is exact, and the rows compared stay in proportion to the texts."""
    amounts = {}

    def measured(kind, f):
        def run(rows, *more):
            amounts[kind] = amounts.get(kind, 0) + rows.count()
            return f(rows, *more)

        return run

    monkeypatch.setattr(near_duplicates, "check_heads", measured("heads", near_duplicates.check_heads))
    monkeypatch.setattr(near_duplicates, "check_units", measured("units", near_duplicates.check_units))
    work = []
    for n in (60, 240):
        words = [f"w{k}" for k in range(20 * n + 60)]
        rows = [(i, " ".join(words[20 * i : 20 * i + 60])) for i in range(n)] + [(1000 + i, " ".join([*words[20 * i : 20 * i + 59], "x"])) for i in range(0, n, 10)]
        amounts.clear()
        # bands of one row: any two neighbours of the chain share a key
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.components(frame(spark, rows), bands=40, rows=1, unit_docs=16).collect()}
        assert got == _components(rows)
        work.append(sum(amounts.values()) / n)
    assert work[1] < 1.5 * work[0]


def test_a_hot_bucket_of_unlinked_texts(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):  # about 0.8 alike, some over the limit, all in common buckets
        own = list(base)
        for k in rng.sample(range(120), 3):
            own[k] = f"e{i}x{k}"
        rows.append((i, " ".join(own)))
    want = _components(rows, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.components(frame(spark, rows), percent=90, bands=40, rows=2, unit_docs=8).collect()}
    assert got == want


def test_quality_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op7_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [(got[i]["score"], y) for i, y in labels.items() if y is not None and got[i]["held_out"]]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert len(good) > 30 and len(bad) > 5
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.9
    assert np.mean([[g > b for b in bad] for g in good]) > 0.93, "the score ranks held-out rows"
    assert abs(np.mean([s for s, _ in held]) - np.mean([y for _, y in held])) < 0.1, "and is calibrated"


def test_held_out_labels_teach_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = queries.remainder(F.col("doc_id"), 4) == 2
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    learn = lambda df: quality.fit(docs, df, train=queries.remainder(F.col("id"), 4) != 2)
    assert learn(labels) == learn(turned)
    many = docs.unionByName(docs.filter("doc_id = 3").withColumn("n", F.explode(F.array_repeat(F.lit(1), 500))).drop("n"))
    assert quality.fit(many, labels) == quality.fit(docs, labels), "repeated rows of an id count once"
    renamed = docs.withColumn("lang", F.when(fold, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language.fit(df, train=queries.remainder(F.col("id"), 4) != 2) for df in (docs, renamed))
    assert a.classes == b.classes and np.array_equal(a.weights, b.weights) and np.array_equal(a.idf, b.idf) and a.temperature == b.temperature


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    true = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op6_language(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(r["score"], r["lang_pred"] == true[i][0]) for i, r in got.items() if r["held_out"] and true[i][0] and r["lang_pred"] != "und"]
    right = np.mean([ok for _, ok in held])
    assert right > 0.95 and abs(np.mean([s for s, _ in held]) - right) < 0.04, "the score is a calibrated probability"


def test_language_by_brute_force(spark):
    """Document frequencies, sample bound, classes: counted again by hand; a rare language among many rows of another is learned."""
    rows = [(i, "der und die nicht " + "abc"[i % 3], "de") for i in range(400)] + [(1000 + i, "os ñandú y agua " + "xyz"[i % 3], "es") for i in range(6)] + [(2000, "never", None), (None, "sin número", "es")]
    docs = spark.createDataFrame(rows + [rows[400]] * 50, "doc_id long, text string, lang string")
    model = language.fit(docs, sample=40)
    assert model.classes == ["de", "es"]
    df = np.zeros(len(model.idf))
    for _, t, c in rows + [rows[400]] * 50:
        if c:
            df[np.unique(language.ngrams(t, model.orders, len(df)))] += 1
    n = len(rows) - 1 + 50
    assert np.allclose(model.idf, np.log((1 + n) / (1 + df)) + 1)
    assert model.predict("ñandú y agua os")[0] == "es" and model.predict("die und der")[0] == "de"
    many = [(k * 100 + i, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} {chr(0x4E00 + k)}", f"l{k:03}") for k in range(230) for i in range(2)]
    assert len(language.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"), buckets=1 << 10, epochs=1).classes) == 230


def test_fold_with_one_sequence_for_the_whole_conversation(spark):
    """Edits and regenerations of earlier messages after later ones."""
    log = [(1, 0, 1, 0, "open", "user", None), (1, 0, 1, 1, "delta", None, "ask"), (1, 1, 1, 2, "open", "assistant", None), (1, 1, 1, 3, "delta", None, "first "), (1, 2, 1, 4, "open", "user", None), (1, 2, 1, 5, "delta", None, "more")]
    log += [(1, 0, 1, 6, "edit", None, "asked"), (1, 1, 1, 7, "delta", None, "late"), (1, 1, 1, 8, "regenerate", None, None), (1, 2, 1, 9, "delta", None, "?"), (1, 1, 1, 10, "delta", None, "second"), (1, 0, 1, 11, "delta", None, "!")]
    df = spark.createDataFrame(log[::-1], "conv_id long, message long, copy int, seq int, kind string, role string, text string")
    got = {r["message"]: (r["role"], r["text"]) for r in chat.fold(df).collect()}
    assert got == {0: ("user", "asked!"), 1: ("assistant", "second"), 2: ("user", "more?")}


def test_other_tokenizers_get_whole_texts(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    rows = [(1, "Two  spaces and\nA Line."), (2, None), (3, " x")]
    _check_packing(packing.pack(frame(spark, rows), path, window=4).collect(), dict(rows), Tokenizer.from_file(path), 4)


def test_every_filling_combination_takes_part():
    table = packing.combinations([1, 2, 3, 4, 7, 8, 9], 10)
    want = {tuple(sorted(c, reverse=True)) for c in [(9, 1, 0), (8, 2, 0), (7, 3, 0), (8, 1, 1), (7, 2, 1), (4, 4, 2), (4, 3, 3)]}
    assert {tuple(r) for r in table.tolist()} == want and len(table) == len(want)
    assert len(packing.combinations(list(range(1, 2049)), 2048)) == 1024 + sum((2048 - c) // 2 - c + 1 for c in range(1, 683))
    target = np.zeros(11)
    target[[9, 1, 4, 2]] = 5, 5, 6, 3
    columns, x = packing.fill(packing.combinations([1, 2, 4, 9], 10), target)
    best = {c: n for c, n in zip(columns, x)}
    assert abs(best[(9, 1)] - 5) < 0.2 and abs(best[(4, 4, 2)] - 3) < 0.2


def test_furniture_named_by_class_goes_on_every_host(spark):
    """Reader comments, adverts and menus whose words change, on hosts with and without articles, large and small."""
    own = lambda i: f"Own words {i} of {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}"
    around = lambda i, body: f"<body class='has-sidebar'><div class='main-menu'>Go {i}</div>{body}<div class='comments'><p>Reader says {i * 31}</p><div>Another {i}</div></div><div class=ad>Buy item {i}</div>"
    plain = lambda i: around(i, f"<div class=content><p>{own(i)}</p></div>")
    marked = lambda i: around(i, f"<article class='post'><p>{own(i)}</p><div id=comments><article class=comment>Said {i}</article></div></article>")
    held = lambda i: f"<body><div class=sidebar-layout-share><main><p>{own(i)}</p></main></div>"
    pages = [(h * 100 + i, f"http://h{h}.example/{i}", make(i)) for h, (make, n) in enumerate([(plain, 60), (marked, 60), (plain, 3), (marked, 3), (held, 40), (held, 41)]) for i in range(n)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages) and all(t == own(i % 100) for i, t in got.items())


def test_depth_changes_nothing():
    import time

    for depth in (400, 600, 20_000):
        assert html.main_text("<b>" * depth + "<nav>menu</nav><div class=comments>c</div>own") == "own"
    assert html.main_text("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><p>h<div>i</div>j") == "a\nb\nc\nd\ne\nf\ng\nh\ni\nj"
    begin = time.time()
    for part in ("<li></li>", "<td></td>", "<p><span>", "<b><p>"):
        html.main_text("<li><ul>" + "<span>" * 60_000 + part * 60_000)
    assert time.time() - begin < 60
