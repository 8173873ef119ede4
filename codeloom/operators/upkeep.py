"""Upkeep of a built graph (rows T5, R12, R3): only what a change of files can touch is read, resolved and written again.

The rows of a graph are kept with their ``owner``, the file that gave them, in tables dealt into buckets by a key:

===========  ========  =====================================================================
table        key       rows
===========  ========  =====================================================================
by_owner_n   owner     node rows as given
by_owner_e   owner     the buckets of src and of dst_raw of the owner's edges, as bits
nodes        id        node rows
labels       label     (label, id, ord) of the canonical nodes
edges        dst_raw   edge rows with known (is the source a node), dst and dst_label, which are resolved
sources      src       (src, owner) of the edge rows, with the buckets of dst_raw as bits
===========  ========  =====================================================================

A change removes the rows of some owners and adds others. Ids of these rows may appear, vanish or change; labels may get
another first node. The edges whose target is such an id or label are resolved again, and those whose source appeared or
vanished are marked; all others stay as they stand and are not shuffled, unless what they are compared with is too large to send.
Edge rows lie in one table; the others only tell which of its buckets to open. A bucket that changes is written anew in a folder of its own; the head,
written last, names the folder of each bucket, so a change that breaks off halfway leaves the state before it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.identity import text
from codeloom.operators.graph import Graph, first_labels, first_per
from codeloom.session import scratch

#: Of the tables' form: a state of another form is none.
FORM = 2
KEYS = {"by_owner_n": "owner", "by_owner_e": "owner", "nodes": "id", "labels": "label", "edges": "dst_raw", "sources": "src"}


@dataclass
class State:
    """The tables of a kept graph: for each, the folder of each bucket."""

    spark: SparkSession
    folder: str
    buckets: int
    schemas: dict = field(default_factory=dict)
    places: dict = field(default_factory=dict)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """The rows of a table, of the buckets ``only``: other buckets are not opened."""
        known = self.places.get(table, {})
        paths = [known[b] for b in sorted(known) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets of one-column frames of keys; as many numbers as there are buckets at most."""
        every = None
        for k in keys:
            own = k.select(self.bucket(F.col(k.columns[0])).alias("b"))
            every = own if every is None else every.unionByName(own)
        return sorted(r.b for r in every.distinct().collect())

    def bits(self, rows: DataFrame, *keys: str, **columns: str) -> DataFrame:
        """(keys, bits): of each of the keys the buckets of other columns, 64 to a number; ``columns``: the names of bits by column."""
        rows = rows.withColumns({f"__{c}": self.bucket(F.col(c)) for c in columns})
        words = range(-(-self.buckets // 64))
        held = lambda c, w: F.expr(f"bit_or(CASE WHEN `__{c}` DIV 64 = {w} THEN shiftleft(1L, `__{c}` % 64) ELSE 0L END)")
        return rows.groupBy(*keys).agg(*[held(c, w).alias(f"{name}{w}") for c, name in columns.items() for w in words])

    def of_bits(self, rows: DataFrame, name: str) -> list[int]:
        """The buckets that any of ``rows`` has in the bits of this name."""
        words = range(-(-self.buckets // 64))
        found = rows.agg(*[F.bit_or(f"{name}{w}") for w in words]).first()
        return [b for b in range(self.buckets) if (found[b // 64] or 0) >> (b % 64) & 1]

    def replaced(self, table: str, only: list[int], rows: DataFrame, deal: bool = True) -> None:
        """Buckets ``only`` of a table hold ``rows`` from now on; nothing is lost before ``commit``. Without ``deal`` each task writes what it has of a bucket."""
        if not only:
            return
        at = f"{self.folder}/{table}-{uuid.uuid4().hex}"
        own = rows.select(*self.schemas[table].names).withColumn("__b", self.bucket(F.col(KEYS[table])))
        own = own.repartition(max(1, min(len(only), 512)), "__b") if deal else own
        own.write.partitionBy("__b").parquet(at)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        there = {s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)}
        places = dict(self.places.get(table, {}))
        for b in only:
            places.pop(b, None)
            if f"__b={b}" in there:
                places[b] = f"{at}/__b={b}"
        self.places = {**self.places, table: places}

    def commit(self) -> None:
        """Writes the head: the state as it is now."""
        head = json.dumps({"form": FORM, "buckets": self.buckets, "schemas": {t: s.jsonValue() for t, s in self.schemas.items()}, "places": self.places})
        _put(self.spark, f"{self.folder}/head.json", head)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> State | None:
        """The state last committed in ``folder``; None without one of this form."""
        from pyspark.sql.types import StructType

        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/head.json")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        head = json.loads(spark.read.text(f"{folder}/head.json", wholetext=True).first().value)
        if head.get("form") != FORM:
            return None
        places = {t: {int(b): p for b, p in own.items()} for t, own in head["places"].items()}
        return State(spark, folder, head["buckets"], {t: StructType.fromJson(s) for t, s in head["schemas"].items()}, places)


def _put(spark: SparkSession, to: str, content: str) -> None:
    """A small file through the store's own client: written beside its place, then renamed over it."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(to).getFileSystem(spark._jsc.hadoopConfiguration())
    beside = fs_path(f"{to}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(content.encode()))
    out.close()
    fs.delete(fs_path(to), False)
    fs.rename(beside, fs_path(to))


def started(spark: SparkSession, folder: str, nodes: DataFrame, edges: DataFrame, buckets: int = 64) -> State:
    """The state of a first build from rows with ``owner``; rows as for ``Graph``, ord may be any value that orders them and stays the same."""
    from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

    n, e = nodes.schema, edges.drop("dst_label", "dst_raw").schema
    kept = StructType([StructField("dst_raw" if f.name == "dst" else f.name, f.dataType) for f in e.fields])
    found = StructType([*kept.fields, StructField("known", BooleanType()), StructField("dst", StringType()), StructField("dst_label", StringType())])
    pick = lambda s, *names: StructType([s[c] for c in names])
    bits = lambda *names: [StructField(f"{x}{w}", LongType()) for x in names for w in range(-(-buckets // 64))]
    by_owner, sources = StructType([kept["owner"], *bits("s", "d")]), StructType([kept["src"], kept["owner"], *bits("d")])
    state = State(spark, folder, buckets, {"by_owner_n": n, "by_owner_e": by_owner, "nodes": n, "labels": pick(n, "label", "id", "ord"), "edges": found, "sources": sources})
    none = spark.createDataFrame([], "owner string")
    return changed(state, none, nodes, edges)


def _canonical(rows: DataFrame) -> DataFrame:
    return first_per(rows.where(text("id") != ""), ["id"])


def _without(rows: DataFrame, owners: DataFrame) -> DataFrame:
    return rows.join(owners, "owner", "left_anti").select(*rows.columns)


def _among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is a key."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi").select(*rows.columns)


def _looked_up(s: State, keys: DataFrame) -> DataFrame:
    """(dst_raw, __again, __id, __own, __by) of each of keys(dst_raw): whether it is a node's id, that node's label, the first node of the label."""
    where = s.touched(keys)
    own = _canonical(_among(s.read("nodes", where), "id", keys)).select(F.col("id").alias("dst_raw"), F.lit(True).alias("__id"), F.col("label").alias("__own"))
    by_label = first_labels(_among(s.read("labels", where), "label", keys)).select(F.col("label").alias("dst_raw"), F.col("label_id").alias("__by"))
    return scratch(keys.withColumn("__again", F.lit(True)).join(own, "dst_raw", "left").join(by_label, "dst_raw", "left"), "looked-up")


def _resolved(rows: DataFrame) -> DataFrame:
    """Edge rows with what their target was looked up to, by id, then by first label; rows that were not looked up stay."""
    again = F.col("__again")
    return rows.withColumns({
        "dst": F.when(again, F.when(F.col("__id"), F.col("dst_raw")).otherwise(F.col("__by"))).otherwise(F.col("dst")),
        "dst_label": F.when(again, F.when(F.col("__id"), F.col("__own")).when(F.col("__by").isNotNull(), F.col("dst_raw"))).otherwise(F.col("dst_label")),
    })


def changed(state: State, owners: DataFrame, nodes: DataFrame, edges: DataFrame) -> State:
    """The state after the rows of ``owners(owner)`` went and ``nodes`` and ``edges`` came; committed.

    A changed file is among the owners and has its new rows, an added one has rows alone, a deleted one is among the owners
    alone. Rows without an owner cannot be removed again.
    """
    s = State(state.spark, state.folder, state.buckets, state.schemas, state.places)
    owners = scratch(owners.select("owner").where("owner is not null").distinct(), "owners")
    new_n = scratch(nodes.select(*s.schemas["nodes"].names), "new-nodes")
    new_e = edges.select(*[F.col("dst").alias("dst_raw") if c == "dst_raw" else F.col(c) for c in s.schemas["edges"].names if c not in ("known", "dst", "dst_label")])
    new_e = scratch(new_e.where((text("src") != "") & (text("dst_raw") != "")), "new-edges")

    # the rows that go are found by their owner
    given = {}
    for table, fresh in (("by_owner_n", new_n), ("by_owner_e", scratch(s.bits(new_e, "owner", src="s", dst_raw="d"), "owner-bits"))):
        gone_at = s.touched(owners)
        given[table] = scratch(_among(s.read(table, gone_at), "owner", owners), "gone")
        at = s.touched(owners, fresh.select("owner").distinct())
        s.replaced(table, at, _without(s.read(table, at), owners).unionByName(fresh))
    old_n, old_e = given["by_owner_n"], given["by_owner_e"]

    # nodes: which ids appeared, vanished or changed
    ids = scratch(old_n.select("id").unionByName(new_n.select("id")).where(text("id") != "").distinct(), "ids")
    at = s.touched(ids)
    rows = s.read("nodes", at)
    after = scratch(_without(rows, owners).unionByName(new_n.where(text("id") != "")), "nodes-after")
    was, now = (_canonical(_among(x, "id", ids)).select("id", "label", "ord") for x in (rows, after))
    s.replaced("nodes", at, after)
    moved = was.select("id", F.col("label").alias("label_was"), F.col("ord").alias("ord_was"), F.lit(True).alias("was")).join(now.select("id", "label", "ord", F.lit(True).alias("now")), "id", "full")
    moved = scratch(moved.where(~(F.col("was").eqNullSafe(F.col("now")) & F.col("label_was").eqNullSafe(F.col("label")) & F.col("ord_was").eqNullSafe(F.col("ord")))), "moved")
    flipped = moved.where("was is null or now is null").select("id")

    # labels: which have another first node
    names = scratch(moved.select(F.explode(F.array("label_was", "label")).alias("label")).where(text("label") != "").distinct(), "names")
    at = s.touched(names)
    listed = s.read("labels", at)
    after = listed.join(moved.select("id"), "id", "left_anti").select("label", "id", "ord")
    after = scratch(after.unionByName(moved.where(F.col("now") & (text("label") != "")).select("label", "id", "ord")), "labels-after")
    first = [first_labels(_among(x, "label", names)) for x in (listed, after)]
    s.replaced("labels", at, after)
    other = first[0].withColumnRenamed("label_id", "before").join(first[1], "label", "full").where("not (before <=> label_id)").select("label")

    # edges: those that came, those that went, and those whose target or source is one of these
    turned = scratch(moved.select(F.col("id").alias("dst_raw")).unionByName(other.select(F.col("label").alias("dst_raw"))).distinct(), "turned")
    from_flipped = scratch(_among(s.read("sources", s.touched(flipped)), "src", flipped), "flipped-sources")
    at = sorted({*s.touched(turned, new_e.select("dst_raw")), *s.of_bits(old_e, "d"), *s.of_bits(from_flipped, "d")})
    rows = _without(s.read("edges", at), owners)
    # kept rows: only those of sources that flipped and of targets that turned are looked at again
    now = scratch(from_flipped.select("src").distinct().join(moved.select(F.col("id").alias("src"), F.coalesce("now", F.lit(False)).alias("__now")), "src"), "flipped-now")
    rows = rows.join(now, "src", "left").withColumn("known", F.coalesce("__now", "known"))
    rows = _resolved(rows.join(_looked_up(s, turned), "dst_raw", "left")).select(*s.schemas["edges"].names)
    # new rows: each different source and target is looked up once
    asked = scratch(new_e.select(F.col("src").alias("id")).distinct(), "asked")
    there = scratch(_among(s.read("nodes", s.touched(asked)), "id", asked).select(F.col("id").alias("src"), F.lit(True).alias("__there")).distinct(), "there")
    fresh = new_e.join(there, "src", "left").withColumns({"known": F.coalesce("__there", F.lit(False)), "dst": F.lit(None).cast("string"), "dst_label": F.lit(None).cast("string")})
    fresh = _resolved(fresh.join(_looked_up(s, scratch(new_e.select("dst_raw").distinct(), "targets")), "dst_raw", "left"))
    s.replaced("edges", at, rows.unionByName(fresh.select(*rows.columns)), deal=False)
    at = sorted({*s.of_bits(old_e, "s"), *s.touched(asked)})
    s.replaced("sources", at, _without(s.read("sources", at), owners).unionByName(s.bits(new_e, "src", "owner", dst_raw="d")))
    s.commit()
    return s


def graph_of(state: State) -> Graph:
    """The built graph (R3) that the state stands for: canonical nodes; edges resolved, canonical, without unknown ends and self edges."""
    # dst follows from dst_raw, so rows without one and self edges can go first
    edges = state.read("edges").where("known and dst is not null and src <> dst").drop("known")
    return Graph(_canonical(state.read("nodes")), first_per(edges.withColumn("file", text("file")), ["src", "dst_raw", "relation", "file"]))
