"""One large JSON document read in blocks, against the standard parser."""

from __future__ import annotations

import json
import random

import pytest

from wayloom.sources import documents, files


def _want(doc):
    """member, pos, value of a parsed document."""
    out = []
    for name, value in doc.items():
        listed = value if isinstance(value, list) else [value]
        out += [(name, pos, v) for pos, v in enumerate(v for v in listed if isinstance(v, dict))]
    return sorted(out, key=lambda r: (r[0], r[1]))


def _got(spark, path):
    return sorted(((r["member"], r["pos"], json.loads(r["value"])) for r in documents.elements(spark, path).collect()), key=lambda r: (r[0], r[1]))


def _value(rng, deep):
    kind = rng.randrange(7 if deep else 4)
    if kind == 0:
        return rng.choice([1, -2.5, True, None, 1e300])
    if kind < 4:
        return "".join(rng.choice(['"', "\\", "}", "{", "]", "[", "a", "é", "\n", ",", ":", "\\\\", '"}', "𝄞"]) for _ in range(rng.randrange(12)))
    if kind < 6:
        return {_value(rng, 0) if rng.random() < 0.2 else "k" * rng.randrange(4): _value(rng, deep - 1) for _ in range(rng.randrange(4))}
    return [_value(rng, deep - 1) for _ in range(rng.randrange(4))]


def _document(rng):
    rows = lambda n: [{"id": i, "x": _value(rng, 3)} for i in range(n)]
    return {"version": '0.6 }{["', "meta": {"id": "m}", "o": {"p": {}}}, "nodes": rows(8), "none": [], "gap": None, "flat": [1, "}", 2], "edges": rows(14), "last": {}}


@pytest.mark.parametrize("size", ["61b", "1000b", "10m"])
def test_elements_at_every_block_size(spark, tmp_path, size):
    rng = random.Random(7)
    docs = [json.loads(json.dumps(_document(rng))) for _ in range(2)]
    for i, doc in enumerate(docs):
        text = json.dumps(doc, indent=[None, 2][i], ensure_ascii=bool(i)) + "\n" * i
        (tmp_path / f"{i}.json").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert _got(spark, f"{tmp_path}/0.json") == _want(docs[0])
        both = documents.elements(spark, str(tmp_path))
        assert both.count() == sum(len(_want(d)) for d in docs) and both.select("path").distinct().count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_readers_use_many_tasks_and_agree_with_the_whole_document(spark, tmp_path):
    nodes = [{"id": i, "lat": 19.0 + i, "lon": 72.0, "pois": ["a}", "b"]} for i in range(30)]
    edges = [{"id": 7 * i % 50, "u": i, "v": i + 1, "length": 2.0, "speed_profile": [1.0, 2.0], "oneway": False, "road_type": "local"} for i in range(50)]
    (tmp_path / "g.json").write_text(json.dumps({"edges": edges, "meta": {"id": "g"}, "nodes": nodes}))
    (tmp_path / "e.json").write_text(json.dumps({"events": [{"id": 9 - i, "type": "knn", "query_point": {"lat": 1.0, "lon": 2.0}} for i in range(9)], "meta": {"id": "e}1"}}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        n, e = files.read_graph(spark, f"{tmp_path}/g.json")
        assert spark.read.text(f"{tmp_path}/g.json", lineSep="}").rdd.getNumPartitions() > 10
        assert [(r["id"], r["pos"], r["speed_profile"], r["active"]) for r in e.orderBy("pos").collect()] == [(7 * i % 50, i, [1.0, 2.0], None) for i in range(50)]
        assert sorted((r["id"], r["lat"], r["pois"]) for r in n.collect()) == [(i, 19.0 + i, ["a}", "b"]) for i in range(30)]
        assert [(r["seq"], r["id"], r["meta_id"], r["query_point"]["lon"]) for r in files.read_events(spark, f"{tmp_path}/e.json").orderBy("seq").collect()] == [(i, 9 - i, "e}1", 2.0) for i in range(9)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_documents(spark, tmp_path):
    for i, text in enumerate(["", "{}", '{"nodes": []}', "{}\n\n"]):
        (tmp_path / f"{i}.json").write_text(text)
        assert documents.elements(spark, f"{tmp_path}/{i}.json").count() == 0
