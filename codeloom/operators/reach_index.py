"""Reachability and distance index (rows Q7, Q8, Q10): strong components, condensation, and 2-hop labels by pruned landmarks around a core.

A label (dir, node, hub, d) says that ``hub`` reaches ``node`` in d hops (dir 0) or that ``node`` reaches ``hub`` in d hops (dir 1).
Nodes without a way out or without a way in are no stop on any other path. They are taken off as the first layer, then those that are
left so as the second, up to ``LAYERS``; what remains is the core. An outer node keeps no labels but its own, and refers to its neighbours further in:
(2 * layer, node, hub, 1) says that what reaches ``hub`` reaches ``node`` a hop later, (2 * layer + 1, node, hub, 1) the like for ways out. A path
takes references out of the first kind, edges of the core and references of the other kind, in this order, so the least sum over common hubs of what
both ends have by labels and references is the distance. Questions are joins, one a layer and one on labels, without a search of the core.
In the core nodes become hubs in the order of their degrees, in batches that grow; all hubs of a batch search in both directions at once, a level
a join, and stop at earlier hubs and at nodes whose distance from them earlier batches already give. No label is lost: of all nodes on
shortest paths between two nodes, the earliest in the order meets only later ones on its way to both. Hubs of one batch do not prune each
other in any other way, which makes some labels more but none wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import numbered, scratch

#: Hubs of the first batch, and how many times as many each next one has.
FIRST, GROWTH = 64, 64
#: Outer layers at most: so many joins lead from any node to the core.
LAYERS = 3
#: A joined table of so many rows is sent to all tasks; one of so many rows a part is held as hashes, which spares sorting the other side.
_SENT, _HELD = 1 << 16, 1 << 20


def _held(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows as the side of a join that tasks hold, if it is small enough for that."""
    if rows <= _SENT:
        return F.broadcast(df)
    return df.hint("shuffle_hash") if rows <= _HELD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _proper(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self edges."""
    return scratch(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct(), "proper")


def _trimmed(pairs: DataFrame) -> DataFrame:
    """The edges that are left when nodes without a way in or out, which stand alone, are taken off until none is."""
    n = pairs.count()
    while n:
        both = pairs.select(F.col("src").alias("id")).distinct().join(pairs.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        rest = pairs.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
        rest = scratch(rest, "trimmed")
        m = rest.count()
        if m == n:
            return rest
        pairs, n = rest, m
    return pairs


def _coloured(pairs: DataFrame) -> DataFrame:
    """(id, colour): the least node that reaches each."""
    ids = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    now = scratch(ids.withColumn("colour", F.col("id")), "colours")
    while True:
        met = pairs.join(now.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "colour")
        after = scratch(now.unionByName(met).groupBy("id").agg(F.min("colour").alias("colour")), "colours")
        if after.join(now, ["id", "colour"], "left_anti").isEmpty():
            return after
        now = after


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of an edge: the least id of those that it reaches and that reach it.

    Nodes without a way in or out are trimmed; the rest take the least node that reaches them for their colour, and what
    reaches a colour's own node without leaving the colour is its component. That is taken out and all is done again.
    """
    pairs = _proper(edges)
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    found = None
    rest = _trimmed(pairs)
    while not rest.isEmpty():
        colour = _coloured(rest)
        inside = rest.join(colour.withColumnsRenamed({"id": "src", "colour": "c"}), "src").join(colour.withColumnsRenamed({"id": "dst", "colour": "e"}), "dst").where("c = e").select("src", "dst")
        inside = scratch(inside, "inside")
        front = seen = scratch(colour.where("id = colour").select("id", "colour"), "back")
        while not front.isEmpty():
            back = inside.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = scratch(back.join(seen, "id", "left_anti"), "back")
            seen = scratch(seen.unionByName(front), "back")
        found = seen if found is None else found.unionByName(seen)
        for end in ("src", "dst"):
            rest = rest.join(seen.select(F.col("id").alias(end)), end, "left_anti")
        rest = _trimmed(scratch(rest.select("src", "dst"), "rest"))
    if found is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(found, "id", "left").select("id", F.coalesce("colour", "id").alias("component"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different components: a graph without cycles."""
    a, b = (components.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c")) for end in ("src", "dst"))
    both = edges.select("src", "dst").join(a, "src").join(b, "dst")
    return both.where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct()


def _outer(pairs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(id) of all nodes, the pairs of the core, and the references of the outer nodes, a table a layer."""
    ids, tables = None, []
    for layer in range(1, LAYERS + 1):
        proper = F.col("src") != F.col("dst")
        ends = pairs.select(F.col("src").alias("id"), proper.alias("o"), F.lit(False).alias("i")).unionByName(pairs.select(F.col("dst").alias("id"), F.lit(False).alias("o"), proper.alias("i")))
        nodes = scratch(ends.groupBy("id").agg(F.max("o").alias("o"), F.max("i").alias("i")), "nodes")
        ids = nodes.select("id") if ids is None else ids
        n = nodes.agg(F.count_if(F.expr("i and not o")).alias("sinks"), F.count_if(F.expr("o and not i")).alias("sources")).first()
        if not (n.sinks or n.sources):
            break
        sinks = nodes.where("i and not o").select(F.col("id").alias("dst"), F.lit(2 * layer).alias("a"))
        sources = nodes.where("o and not i").select(F.col("id").alias("src"), F.lit(2 * layer + 1).alias("b"))
        marked = pairs.where(proper).join(_held(sinks, n.sinks), "dst", "left").join(_held(sources, n.sources), "src", "left")
        marked = scratch(marked.select(F.coalesce("a", "b", F.lit(0)).alias("dir"), "src", "dst"), "marked")
        for k, node, hub in ((2 * layer, "dst", "src"), (2 * layer + 1, "src", "dst")):
            tables.append(marked.where(F.col("dir") == k).select("dir", F.col(node).alias("node"), F.col(hub).alias("hub"), F.lit(1).alias("d")))
        pairs = marked.where("dir = 0").select("src", "dst")
    return ids, pairs.where("src <> dst"), tables


def distance_labels(edges: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(dir, node, hub, d) of all nodes of an edge: labels of the core, each node's own, references of outer nodes.

    The tables behind it are written, the own labels are made of the nodes as they are read.
    """
    pairs = scratch(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "pairs")
    ids, core, tables = _outer(pairs)
    own = ids.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("dir"), F.col("id").alias("node"), F.col("id").alias("hub"), F.lit(0).alias("d"))
    for t in [_core_labels(core, first, growth), *tables]:
        own = own.unionByName(t)
    return own


def _core_labels(pairs: DataFrame, first: int, growth: int) -> DataFrame:
    """The labels of different nodes of the core. Rounds: levels of a search times the batches, a logarithm of the nodes.

    Inside nodes are numbers, and a node and a direction are one number, ``at`` = 2 * node + dir.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("at"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("at"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    degree = ends.groupBy("at").agg((F.sum("o") + 1).alias("a"), (F.count("*") - F.sum("o") + 1).alias("b"))
    # written before it is sorted, which reads it twice
    order = scratch(degree.select(F.col("at").alias("node"), (-F.col("a") * F.col("b")).alias("w")), "degrees")
    order = scratch(numbered(order, ["w", "node"], "rank").select("node", F.col("rank").cast("long").alias("rank")), "order")
    n = order.count()
    of = lambda end: order.select(F.col("node").alias(end), F.col("rank").alias(end[0]))
    ways = scratch(pairs.join(of("src"), "src").join(of("dst"), "dst").select("s", "d"), "ways")
    ways = ways.select(F.explode(F.array(F.struct((2 * F.col("s")).alias("at"), (2 * F.col("d")).alias("to")), F.struct((2 * F.col("d") + 1).alias("at"), (2 * F.col("s") + 1).alias("to")))).alias("x")).select("x.*")
    labels = None
    low, size = 0, first
    while low < n:
        hubs = order.where((F.col("rank") >= low) & (F.col("rank") < low + size)).select(F.col("rank").alias("hub"))
        front = own = scratch(hubs.select(F.explode(F.array(2 * F.col("hub"), 2 * F.col("hub") + 1)).alias("at"), "hub", F.lit(0).alias("d")), "front")
        through = _through(labels) if low else None
        d = 0
        while True:
            d += 1
            # a path over an earlier hub is that hub's own, whose search meets both ends
            step = front.join(ways, "at").where(F.shiftright("to", 1) > F.col("hub")).select(F.col("to").alias("at"), "hub").distinct()
            step = step.join(own, ["at", "hub"], "left_anti")
            if through is not None:
                step = scratch(step, "step")
                step = step.join(_known(step, through, d), ["at", "hub"], "left_anti")
            front = scratch(step.withColumn("d", F.lit(d)), "front")
            if front.isEmpty():
                break
            own = own.unionByName(front) if d % 8 else scratch(own.unionByName(front), "own")
        labels = own if labels is None else labels.unionByName(own)
        low, size = low + size, size * growth
    if labels is None:
        return order.select(F.lit(0).alias("dir"), "node", F.col("node").alias("hub"), F.lit(0).alias("d"))
    named = labels.where("d > 0").withColumn("rank", F.shiftright("at", 1)).join(order, "rank").drop("rank")
    named = named.withColumnRenamed("hub", "rank").join(order.select("rank", F.col("node").alias("hub")), "rank")
    return scratch(named.select(F.col("at").bitwiseAND(F.lit(1).cast("long")).cast("int").alias("dir"), "node", "hub", "d"), "labels")


def _through(labels: DataFrame) -> DataFrame | None:
    """Labels by hubs that others reach and that reach others, with the number of them at each ``at``; None if there are none. Only they can give a distance between two other nodes."""
    proper = labels.where("d > 0")
    both = proper.groupBy("hub").agg(F.min(F.col("at") % 2).alias("a"), F.max(F.col("at") % 2).alias("b")).where("a < b").select("hub")
    kept = scratch(proper.join(both, "hub", "left_semi").select("at", F.col("hub").alias("via"), F.col("d").alias("dv")), "through")
    if kept.isEmpty():
        return None
    sizes = kept.groupBy("at").agg(F.count("*").alias("n"))
    return scratch(kept.join(sizes, "at"), "through")


def _known(step: DataFrame, through: DataFrame, d: int) -> DataFrame:
    """The (at, hub) of ``step`` whose distance earlier labels give. Of each pair the end with fewer labels looks up the other's."""
    sizes = scratch(through.select("at", "n").distinct(), "sizes")
    mirror = 2 * F.col("hub") + 1 - F.col("at") % 2
    both = step.withColumn("there", mirror).join(sizes, "at").join(sizes.select(F.col("at").alias("there"), F.col("n").alias("m")), "there")
    both = scratch(both, "both")
    found = None
    for near, far, fewer in (("at", "there", "n <= m"), ("there", "at", "n > m")):
        one, other = (through.select(F.col("at").alias(x), "via", F.col("dv").alias(y)) for x, y in ((near, "d1"), (far, "d2")))
        met = both.where(fewer).select("at", "there", "hub").join(one, near).join(other, [far, "via"]).where(F.col("d1") + F.col("d2") <= d).select("at", "hub")
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def _labels_of(labels: DataFrame, ids: DataFrame, side: int) -> DataFrame:
    """(id, hub, d): what reaches ids(id) (side 0), or what they reach (side 1), by labels and references."""
    at = ids.select("id", F.col("id").alias("node"), F.lit(0).alias("k")).distinct()
    for layer in range(1, LAYERS + 1):
        # what is known so far is written: if it is small, it is sent to all tasks
        at = scratch(at, "at")
        further = labels.where(F.col("dir") == 2 * layer + side).select("node", "hub").join(at, "node").select("id", F.col("hub").alias("node"), F.col("k") + 1)
        at = at.unionByName(further.toDF("id", "node", "k")).groupBy("id", "node").agg(F.min("k").alias("k"))
    at = scratch(at, "at")
    met = labels.where(F.col("dir") == side).join(at, "node").select("id", "hub", (F.col("d") + F.col("k")).alias("d"))
    return scratch(met.groupBy("id", "hub").agg(F.min("d").alias("d")), "labels-of")


def distances(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, hops) of the pairs(src, dst) with a path; a node is 0 hops from itself."""
    pairs = pairs.select("src", "dst").distinct()
    out = _labels_of(labels, pairs.select(F.col("src").alias("id")), 1).select(F.col("id").alias("src"), "hub", F.col("d").alias("d1"))
    into = _labels_of(labels, pairs.select(F.col("dst").alias("id")), 0).select(F.col("id").alias("dst"), "hub", F.col("d").alias("d2"))
    met = pairs.join(out, "src").join(into, ["dst", "hub"])
    return met.groupBy("src", "dst").agg(F.min(F.col("d1") + F.col("d2")).alias("hops"))


def all_from(labels: DataFrame, subjects: DataFrame, reverse: bool = False) -> DataFrame:
    """(subject, id, hops) of every node that a subject(subject) reaches, or with ``reverse`` that reaches it (Q7 for all subjects at once), itself left out."""
    near = _labels_of(labels, subjects.select(F.col("subject").alias("id")), 0 if reverse else 1)
    return _met(labels, near, 1 if reverse else 0).where("subject <> id")


def _met(labels: DataFrame, near: DataFrame, side: int) -> DataFrame:
    """(subject, id, hops) of every node with a label or reference of ``side`` to the hubs of near(id, hub, d). Nodes of inner layers are known before those that refer to them, so each reference is read once."""
    near = near.select(F.col("id").alias("subject"), "hub", F.col("d").alias("near"))
    found = labels.where(F.col("dir") == side).join(near, "hub").groupBy("subject", F.col("node").alias("id")).agg(F.min(F.col("d") + F.col("near")).alias("hops"))
    for layer in range(LAYERS, 0, -1):
        found = scratch(found, "met")
        refer = labels.where(F.col("dir") == 2 * layer + side).select("node", F.col("hub").alias("id"))
        more = refer.join(_held(found, found.count()), "id").groupBy("subject", F.col("node").alias("id")).agg((F.min("hops") + 1).alias("hops"))
        found = found.unionByName(more)
    return found.groupBy("subject", "id").agg(F.min("hops").alias("hops"))


def path(labels: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """Q8, Q10 by the index: (hop, id) of the lexicographically least shortest path; the next node is the least neighbour that is a hop nearer."""
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0, source)], "hop int, id string")
    one = lambda x, side: _labels_of(labels, spark.createDataFrame([(x,)], "id string"), side)
    into = one(target, 0)
    hops = one(source, 1).select("hub", F.col("d").alias("d1")).join(into, "hub").agg(F.min(F.col("d1") + F.col("d"))).first()[0]
    if hops is None:
        return spark.createDataFrame([], "hop int, id string")
    # nodes with their hops to the target, then the edges that lead a hop nearer: labels and edges are read once, not once a hop
    left = scratch(_met(labels, into, 1).select(F.col("id").alias("node"), F.col("hops").alias("left")).where(F.col("left") < hops), "left")
    ahead = edges.select("src", "dst").join(left.withColumnRenamed("node", "dst"), "dst").distinct()
    ahead = scratch(ahead.join(left.select(F.col("node").alias("src"), F.col("left").alias("own")), "src", "left").where((F.col("src") == source) | (F.col("own") == F.col("left") + 1)), "ahead")
    way = [source]
    while len(way) <= hops:
        way.append(ahead.where((F.col("src") == way[-1]) & (F.col("left") == hops - len(way))).agg(F.min("dst")).first()[0])
    return spark.createDataFrame(list(enumerate(way)), "hop int, id string")


def verdict(labels: DataFrame, source: str, target: str) -> str:
    """Why there is or is no path: ``path``, ``reversed`` (only the other way round), ``unknown source``, ``unknown target`` or ``apart``."""
    spark = labels.sparkSession
    there = {r.node for r in labels.where(F.col("node").isin(source, target)).select("node").distinct().collect()}
    if source not in there:
        return "unknown source"
    if target not in there:
        return "unknown target"
    found = {r.src for r in distances(labels, spark.createDataFrame([(source, target), (target, source)], "src string, dst string")).collect()}
    return "path" if source in found else "reversed" if target in found else "apart"

