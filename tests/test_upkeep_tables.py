"""The tables beside the edges tell buckets only: their rows do not grow with the edges of an owner or a source."""

from codeloom.operators import upkeep

NODES = "id string, label string, kind string, file string, owner string, ord long"
EDGES = "src string, dst string, relation string, confidence string, score double, file string, owner string, ord long"


def test_owners_and_sources_hold_bits_of_buckets(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{k}", f"l{k}", "function", f"f{k % 3}", f"f{k % 3}", k) for k in range(90)], NODES)
    edges = spark.createDataFrame([("n0", f"n{k}", "calls", "", 0.0, "f0", "f0", k) for k in range(1, 90)] + [("n1", "l5", "calls", "", 0.0, "f1", "f1", 99)], EDGES)
    state = upkeep.started(spark, str(tmp_path), nodes, edges, buckets=70)
    owners = state.read("by_owner_e")
    assert owners.count() == 2 and state.read("sources").count() == 2 and state.read("edges").count() == 90
    first = owners.where("owner = 'f0'")
    want = {r.b for r in edges.where("owner = 'f0'").select(state.bucket(edges.dst).alias("b")).collect()}
    assert set(state.of_bits(first, "d")) == want and max(want) > 63 and len(state.of_bits(first, "s")) == 1
    assert state.of_bits(owners.where("false"), "d") == []
    after = upkeep.changed(state, spark.createDataFrame([("f0",)], "owner string"), nodes.where("owner = 'f0'"), edges.where("false"))
    assert [r.owner for r in after.read("by_owner_e").collect()] == ["f1"] and after.read("edges").count() == 1
