"""Writers of tasks, their commit, and documents read in ranges."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.exports import documents, staged, vault
from codeloom.operators.graph import Graph
from codeloom.sources import graph_json, line_document


def graph(spark, n=500):
    nodes = spark.range(n).select(F.concat(F.lit("n:"), "id").alias("id"), F.concat(F.lit('a"\n\\ü'), F.col("id").cast("string")).alias("label"), F.lit("func").alias("kind"), F.lit("").alias("file"), F.lit("").alias("source_id"), F.lit("").alias("source_name"), F.lit("").alias("organization"), F.lit("").alias("description"), (n - F.col("id")).alias("ord"))
    edges = spark.range(n - 1).select(F.concat(F.lit("n:"), "id").alias("src"), F.concat(F.lit("n:"), F.col("id") + 1).alias("dst"), F.lit("calls").alias("relation"), F.lit("").alias("file"), F.lit("DECLARED").alias("confidence"), F.lit(0.5).alias("score"), F.col("id").alias("ord"))
    return Graph(nodes.repartition(7), edges.repartition(5))


def test_document_is_whole_and_ordered(spark, tmp_path):
    g, path = graph(spark), str(tmp_path / "g.json")
    documents.write_json(g, path)
    doc = json.load(open(path, encoding="utf-8"))
    assert [x["id"] for x in doc["nodes"]] == [f"n:{499 - i}" for i in range(500)]
    assert [x["from"] for x in doc["edges"]] == [f"n:{i}" for i in range(499)]
    assert doc["meta"]["nodeCount"] == 500 and doc["meta"]["edgeCount"] == 499
    assert os.listdir(tmp_path) == ["g.json"]


def test_ranges_give_each_line_once(spark, tmp_path):
    path = str(tmp_path / "g.json")
    documents.write_json(graph(spark, 12), path)
    doc = json.load(open(path))
    for section in ("nodes", "edges"):
        for split in (1, 2, 37, 100, 1 << 20):
            reader = line_document._Reader(path, section, split)
            got = [json.loads(x) for p in reader.partitions() for b in reader.read(p) for x in b.column("json").to_pylist()]
            assert got == doc[section]
        got = line_document.lines(spark, path, section, 500)
        assert [json.loads(r.json) for r in got.orderBy("ord").collect()] == doc[section] and got.rdd.getNumPartitions() > 1


def test_document_in_lines_equals_one_value(spark, tmp_path):
    g, path, flat = graph(spark, 40), str(tmp_path / "g.json"), str(tmp_path / "flat.json")
    documents.write_json(g, path)
    json.dump(json.load(open(path)), open(flat, "w"))
    assert line_document.in_lines(path) and not line_document.in_lines(flat) and not line_document.in_lines(str(tmp_path))
    a, b = graph_json.read_graph(spark, path), graph_json.read_graph(spark, flat)
    for x, y in ((a.nodes, b.nodes), (a.edges, b.edges)):
        rest = [c for c in y.columns if c != "ord"]
        assert [r[:] for r in x.orderBy("ord").select(*rest).collect()] == [r[:] for r in y.orderBy("ord").select(*rest).collect()]
    cut = tmp_path / "cut.json"
    cut.write_bytes(open(path, "rb").read()[:-9])
    warnings: list[str] = []
    assert graph_json.read_graphs(spark, [str(cut), path], warnings).nodes.count() == 40 and "cut off" in warnings[0]


def test_empty_documents(spark, tmp_path):
    g, path = graph(spark, 3), str(tmp_path / "g.json")
    none = Graph(g.nodes.limit(0), g.edges.limit(0))
    documents.write_json(none, path)
    doc = json.load(open(path))
    assert doc["nodes"] == doc["edges"] == [] and doc["meta"]["nodeCount"] == 0
    assert graph_json.read_graph(spark, path).nodes.count() == 0
    assert vault.write_vault(none, str(tmp_path / "v")) == 0


def _failing(marked: str):
    @F.udf("string")
    def fail(x):
        if x == marked:
            raise ValueError("lost halfway")
        return x

    return fail


def test_failed_task_leaves_the_old_output(spark, tmp_path):
    path, folder = str(tmp_path / "g.json"), str(tmp_path / "vault")
    g = graph(spark, 30)
    documents.write_json(g, path)
    staged.write_files(spark.createDataFrame([("a/x.md", "old"), ("b.md", None)], "path string, text string"), folder)
    before = open(path).read()
    bad = Graph(g.nodes.withColumn("label", _failing('a"\n\\ü17')("label")), g.edges)
    with pytest.raises(Exception, match="lost halfway"):
        documents.write_json(bad, path)
    rows = spark.createDataFrame([("a/x.md", "new"), ("c.md", "17")], "path string, text string").repartition(2).withColumn("text", _failing("17")("text"))
    with pytest.raises(Exception, match="lost halfway"):
        staged.write_files(rows, folder)
    assert open(path).read() == before and sorted(os.listdir(tmp_path)) == ["g.json", "vault"]
    assert open(f"{folder}/a/x.md").read() == "old" and open(f"{folder}/b.md").read() == "" and sorted(os.listdir(folder)) == ["a", "b.md"]


def test_committed_files_are_published_after_a_crash(spark, tmp_path):
    folder = str(tmp_path / "v")
    stage = f"{folder}/.staged-1"
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.md", str(i)) for i in range(20)], "path string, text string").repartition(4)
    staged._stage(rows, staged.StagedFiles, stage)
    # what an attempt that does not count left behind, and a move that was cut off
    os.makedirs(f"{stage}/0000000-lost/d0")
    open(f"{stage}/0000000-lost/d0/f0.md", "w").write("wrong")
    first = staged._committed(stage)[0][0]
    at, _, names = next(x for x in os.walk(first) if x[2])
    os.makedirs(os.path.join(folder, os.path.relpath(at, first)))
    os.replace(os.path.join(at, names[0]), os.path.join(folder, os.path.relpath(at, first), names[0]))
    assert staged.publish(spark, folder) == 20 and staged.publish(spark, folder) == 0
    assert {f"d{i % 3}/f{i}.md": str(i) for i in range(20)} == {os.path.relpath(os.path.join(a, f), folder): open(os.path.join(a, f)).read() for a, _, fs in os.walk(folder) for f in fs}


def test_nodes_of_one_path_share_a_note(spark, tmp_path):
    g = graph(spark, 2)
    same = Graph(g.nodes.withColumn("label", F.lit("same")), g.edges)
    assert vault.write_vault(same, str(tmp_path)) == 1
    (note,) = [os.path.join(a, f) for a, _, fs in os.walk(tmp_path) for f in fs]
    assert 'id: "n:0"' in open(note).read() and 'id: "n:1"' in open(note).read()


def test_push_rejects(spark, tmp_path):
    sent, rejects = str(tmp_path / "sent"), str(tmp_path / "rejects")
    os.makedirs(sent)

    def connect():
        def run(statement):
            if "'n:3'" in statement:
                raise RuntimeError("refused")
            # an edge needs its nodes
            if statement.startswith("MATCH") and len([x for x in os.listdir(sent) if x.startswith("n")]) != 9:
                raise RuntimeError("too early")
            open(f"{sent}/{'e' if statement.startswith('MATCH') else 'n'}{hash(statement)}", "w").write(statement)

        return run

    assert documents.push(graph(spark, 10), connect, rejects) == 3
    got = spark.read.parquet(rejects).orderBy("part", "ord").collect()
    assert [r.part for r in got] == [0, 1, 1] and {r.error for r in got} == {"RuntimeError: refused"} and len(os.listdir(sent)) == 16
