"""A document's text is on disk once while it is written, and only ranges with lines of a section are read for it."""

import json
import os

from pyspark.sql import functions as F

from codeloom.exports import staged
from codeloom.sources import graph_json, line_document


def test_text_is_staged_compressed_and_once(spark, tmp_path, monkeypatch):
    seen = []

    def replaced(a, b, real=os.replace):
        if b == path:
            stage = os.path.dirname(a)
            seen.append((sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(stage) for x in names) - os.path.getsize(a), os.path.getsize(a)))
        real(a, b)

    monkeypatch.setattr(os, "replace", replaced)
    path = str(tmp_path / "d[1].json")
    rows = spark.range(20_000).repartition(7).select(F.col("id").alias("ord"), F.to_json(F.struct(F.col("id"), F.lit("ü" * 50).alias("text"))).alias("json"))
    counts = staged.write_document({"a": rows, "none": rows.limit(0), "b": rows.where("id < 9000")}, path, {"version": 1}, lambda n: {"all": n["a"] + n["b"]})
    assert counts == {"a": 20_000, "none": 0, "b": 9000} and os.listdir(tmp_path) == ["d[1].json"]
    doc = json.load(open(path, encoding="utf-8"))
    assert [x["id"] for x in doc["a"]] == list(range(20_000)) and [x["id"] for x in doc["b"]] == list(range(9000)) and doc["none"] == [] and doc["all"] == 29_000
    (beside, size), = seen
    assert beside < size / 2


def test_only_ranges_of_the_section_are_read(tmp_path):
    path = str(tmp_path / "g.json")
    nodes = [json.dumps({"id": f"n{k}"}, separators=(",", ":")) for k in range(50)]
    edges = [json.dumps({"from": f"n{k}", "to": "ü"}, separators=(",", ":"), ensure_ascii=False) for k in range(70)]
    text = '{"nodes":[\n' + ",\n".join(nodes) + '\n],"edges":[\n' + ",\n".join(edges) + '\n],"meta":{}}\n'
    open(path, "wb").write(text.encode().replace(b"n69", b"n\xff"))
    all_ranges = -(-os.path.getsize(path) // 100)
    n = 0
    for section, want in (("nodes", nodes), ("edges", [x.replace("n69", "n�") for x in edges])):
        reader = line_document._Reader(path, section, 100)
        parts = reader.partitions()
        n += len(parts)
        assert [x for p in parts for b in reader.read(p) for x in b.column("json").to_pylist()] == want
    assert n <= all_ranges + 6


def test_metadata_are_read_as_their_json(spark, tmp_path):
    """Text without its quotes, any other value as JSON, null and missing ones as nothing; the raw metadata stay."""
    path = str(tmp_path / "m.json")
    metas = ['{"layer":"a\\"b","verification":1.50,"bound_target":{"x":[1,null]},"binding_state":true,"projected_from":null,"binding_suggestions":["p","q"]}', '"text"', "null", "{}", '{"layer":"","binding_suggestions":[]}', '{"Layer":"other","evidence_source_artifact":"f"}']
    rows = [f'{{"from":"n","to":"t{k}","metadata":{m}}}' for k, m in enumerate(metas)]
    open(path, "w").write('{"nodes":[\n{"id":"n","metadata":{"layer":"L","canonical_key":"K"}}\n],"edges":[\n' + ",\n".join(rows) + '\n],"meta":{}}\n')
    g = graph_json.read_graph(spark, path)
    names = graph_json.EDGE_METADATA
    want = g.edges.select("dst", *[F.coalesce(F.get_json_object("metadata", f"$.{v}"), F.lit("")).alias(k) for k, v in names.items()], F.from_json(F.get_json_object("metadata", "$.binding_suggestions"), "array<string>").alias("binding_suggestions"))
    got = {r.dst: r for r in g.edges.select("dst", *names, "binding_suggestions").collect()}
    assert got == {r.dst: r for r in want.collect()} and got["t0"].layer == 'a"b' and got["t0"].binding_suggestions == ["p", "q"] and got["t5"].layer == ""
    assert [(r.layer, r.canonical_key) for r in g.nodes.collect()] == [("L", "K")]
    # a line of a node once, a line of an edge once, its metadata and its suggestions
    plan = g.edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 4, plan
