"""Upkeep of a graph: any series of adds, changes and deletes equals the full build."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import upkeep
from codeloom.operators.graph import Graph

NODES = "id string, label string, kind string, file string, owner string, ord struct<o:string,n:int>"
EDGES = "src string, dst string, relation string, confidence string, score double, file string, owner string, ord struct<o:string,n:int>"


def rows_of(rng, owner):
    """Nodes and edges of a file; ids and labels of other files come up too."""
    name = lambda: f"{rng.choice('abcd')}{rng.randint(0, 3)}"
    nodes = [(rng.choice([f"{owner}:{name()}", name(), ""]), rng.choice([name(), "", None]), "function", owner, owner, (owner, k)) for k in range(rng.randint(0, 4))]
    ends = [n[0] for n in nodes] + [name(), "f1:a1", "f2:b0"]
    edges = [(rng.choice(ends), rng.choice([*ends, name(), name(), "", None]), rng.choice(["calls", "uses"]), "EXTRACTED", 0.0, rng.choice([owner, "", None]), owner, (owner, 100 + k)) for k in range(rng.randint(0, 6))]
    return nodes, edges


def result(g):
    nodes = sorted(map(str, g.nodes.select("id", "label", "owner", "ord").collect()))
    return nodes, sorted(map(str, g.edges.select("src", "dst", "dst_raw", "dst_label", "relation", "file", "owner", "ord").collect()))


def full(spark, files):
    frame = lambda k, schema: spark.createDataFrame([r for _, f in sorted(files.items()) for r in f[k]], schema)
    return Graph(frame(0, NODES), frame(1, EDGES)).built()


@pytest.mark.parametrize("seed", [1, 2])
def test_any_series_of_changes_equals_the_full_build(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = {f"f{k}": rows_of(rng, f"f{k}") for k in range(4)}
    frame = lambda own, k, schema: spark.createDataFrame([r for f in own.values() for r in f[k]], schema)
    state = upkeep.started(spark, str(tmp_path), frame(files, 0, NODES), frame(files, 1, EDGES), buckets=5)
    assert result(upkeep.graph_of(state)) == result(full(spark, files))
    for _ in range(4):
        gone = rng.sample(sorted(files), min(len(files), rng.randint(0, 2)))
        fresh = {n: rows_of(rng, n) for n in {*rng.sample(gone, rng.randint(0, len(gone))), *([f"f{rng.randint(4, 9)}"] if rng.random() < 0.7 else [])}}
        gone = sorted({*gone, *(set(fresh) & set(files))})
        files = {**{k: v for k, v in files.items() if k not in gone}, **fresh}
        owners = spark.createDataFrame([(g,) for g in gone], "owner string")
        upkeep.changed(upkeep.State.load(spark, str(tmp_path)), owners, frame(fresh, 0, NODES), frame(fresh, 1, EDGES))
        assert result(upkeep.graph_of(upkeep.State.load(spark, str(tmp_path)))) == result(full(spark, files))


def test_only_touched_buckets_are_replaced_and_a_broken_change_leaves_the_old_state(spark, tmp_path):
    nodes = [(f"n{k}", f"l{k}", "function", f"f{k}", f"f{k}", (f"f{k}", 0)) for k in range(60)]
    edges = [(f"n{k}", f"l{(k + 1) % 60}", "calls", "", 0.0, f"f{k}", f"f{k}", (f"f{k}", 1)) for k in range(60)]
    state = upkeep.started(spark, str(tmp_path), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), buckets=32)
    before = result(upkeep.graph_of(state))
    owners = spark.createDataFrame([("f7",)], "owner string")
    fresh = spark.createDataFrame([("n7", "other", "function", "f7", "f7", ("f7", 0))], NODES)
    broken = fresh.withColumn("label", F.expr("assert_true(false, 'lost')").cast("string"))
    with pytest.raises(Exception, match="lost"):
        upkeep.changed(state, owners, broken, spark.createDataFrame([], EDGES))
    assert result(upkeep.graph_of(upkeep.State.load(spark, str(tmp_path)))) == before
    after = upkeep.changed(state, owners, fresh, spark.createDataFrame([], EDGES))
    for table, most in (("by_owner_n", 1), ("by_owner_e", 1), ("nodes", 1), ("labels", 2), ("edges", 4), ("sources", 1)):
        new = {b for b, p in after.places[table].items() if state.places[table].get(b) != p}
        assert len(new | (set(state.places[table]) - set(after.places[table]))) <= most, table
    assert len(upkeep.graph_of(after).edges.collect()) == 58  # n7 calls nobody, and nobody is called l7


def test_a_build_parses_changed_files_alone(spark, tmp_path):
    from codeloom.plans import build as B
    from codeloom.plans import reuse

    root = tmp_path / "shop"
    (root / "lib").mkdir(parents=True)
    (root / "a.py").write_text("from lib import b\n\ndef one():\n    two()\n")
    (root / "lib" / "b.py").write_text("def two():\n    three()\n")
    (root / "lib" / "c.py").write_text("def three():\n    pass\n")
    builder = B.Builder(spark, cluster=lambda g: g.nodes.select("id", F.lit(0).alias("community")))
    request = B.BuildRequest(str(root))
    out = builder.run(request)
    kept = str(tmp_path / "kept")
    reuse.write_build(out.graph, out.manifest, kept, out.rows)
    saved = reuse.read_build(spark, kept)
    assert builder.run(request, saved).mode == "reused"
    (root / "lib" / "b.py").write_text("def two():\n    four()\n\ndef four():\n    pass\n")
    (root / "lib" / "c.py").unlink()
    (root / "d.py").write_text("def five():\n    four()\n")
    part = builder.run(request, saved)
    assert (part.mode, part.refused) == ("changed_files", "")
    whole = builder.run(request)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(part.graph.nodes.drop("community")) == key(whole.graph.nodes.drop("community")) and key(part.graph.edges) == key(whole.graph.edges)
    # what is known of an unchanged file is taken as it is: the file itself is not parsed
    odd = saved.rows.withColumn("name", F.when((F.col("path") == "a.py") & (F.col("part") == "symbol"), "kept").otherwise(F.col("name")))
    again = builder.run(request, reuse.Saved(saved.graph, saved.manifest, saved.version, saved.fingerprint, saved.written, odd))
    assert {r.label for r in again.graph.nodes.where("file = 'a.py' and kind = 'function'").collect()} == {"kept"}


def test_engine_by_the_index(spark):
    from codeloom.plans.engine import Engine

    nodes = [(x, x.upper(), "function", "", k) for k, x in enumerate("abcdez")]
    edges = [(a, b, "calls", "", 0.0, "", k) for k, (a, b) in enumerate(["ab", "bc", "ac", "cd", "eb"])]
    g = Graph(spark.createDataFrame(nodes, "id string, label string, kind string, file string, ord int"), spark.createDataFrame(edges, "src string, dst string, relation string, confidence string, score double, file string, ord int"))
    plain, fast = Engine(g), Engine(g)
    fast.index()
    for e in (plain, fast):
        assert {(r.id, r.hops) for r in e.impacted("d").collect()} == {("c", 1), ("a", 2), ("b", 2), ("e", 3)}
        assert [r.id for r in e.path("e", "d").orderBy("hop").collect()] == ["e", "b", "c", "d"]
        assert e.no_path("a", "d") == "" and e.no_path("d", "a").startswith("only 'a'") and e.no_path("e", "a").startswith("neither") and "no edge" in e.no_path("z", "a")
    lines = [r.line for r in plain.impact_lines("d", 2).collect()]
    assert lines == ["A [function] by way of A [function] > C [function] > D [function]", "B [function] by way of B [function] > C [function] > D [function]"] or all("by way of" in x for x in lines)
