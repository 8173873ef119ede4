"""Communities of high modularity (rows A6a, A6b): local moves, refinement and contraction as joins, communities split into connected parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import scratch

#: A level that gains less modularity than this ends the search.
LEAST_GAIN = 1e-7
#: How far chance may choose a refinement of less gain, in weights of edges.
THETA = 0.01


def _weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions: each pair of linked nodes once, whatever its edges; self loops and unknown ends are left out."""
    known = nodes.select("id").distinct()
    e = edges.select("src", "dst").where("src <> dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    pairs = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")
    return both.withColumn("w", F.lit(1.0))


def _quality(weights: DataFrame, degree: DataFrame, labels: DataFrame, total: float) -> float:
    """Modularity of ``labels(id, label)``, one number."""
    ends = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    inside = weights.join(ends[0], "src").join(ends[1], "dst").where("a = b").select((F.col("w") / total).alias("q"))
    spread = degree.join(labels, "id").groupBy("label").agg(F.sum("k").alias("t")).select((-F.col("t") * F.col("t") / (total * total)).alias("q"))
    return inside.unionByName(spread).agg(F.sum("q")).first()[0] or 0.0


def _moved(weights: DataFrame, degree: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """Labels after one half of the nodes, dealt anew by ``turn``, took the neighbouring label of most gain, the least of equals."""
    tot = degree.join(labels, "id").groupBy("label").agg(F.sum("k").alias("t"))
    links = weights.where("src <> dst").join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("l"))
    own = labels.select("id", F.col("label").alias("own")).join(degree, "id")
    asked = links.unionByName(labels.withColumn("l", F.lit(0.0))).groupBy("id", "label").agg(F.sum("l").alias("l"))
    at = asked.join(own, "id").join(tot, "label")
    rest = F.col("t") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
    at = at.withColumn("gain", F.col("l") - F.col("k") * rest / F.lit(total))
    best = at.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("label"))).alias("b"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("here"), F.first("own").alias("own"))
    goes = (-F.col("b.g") > F.col("here") + 1e-12) & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
    return best.select("id", F.when(goes, F.col("b.label")).otherwise(F.col("own")).alias("label"))


def _connected(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """Each community's connected parts, named after their least node: a part of its own never lowers modularity."""
    ends = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    inner = scratch(weights.where("src <> dst").join(ends[0], "src").join(ends[1], "dst").where("a = b").select("src", "dst"), "inner")
    part = labels.select("id", F.col("id").alias("label"))
    while True:
        seen = inner.join(part.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label")
        # the least node of the neighbours, and of the node that is least so far
        least = scratch(part.unionByName(seen).groupBy("id").agg(F.min("label").alias("label")), "parts")
        hop = least.join(least.select(F.col("id").alias("label"), F.col("label").alias("further")), "label").select("id", F.col("further").alias("label"))
        hop = scratch(hop, "parts")
        if hop.join(part.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty():
            return hop
        part = hop


def _level(weights: DataFrame, total: float) -> tuple[DataFrame, float]:
    """Local moves from one label a node until two turns in a row gain nothing; (labels, modularity)."""
    degree = scratch(weights.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "degree")
    best = scratch(degree.select("id", F.col("id").alias("label")), "labels")
    quality, idle, turn = _quality(weights, degree, best, total), 0, 0
    while idle < 2:
        labels = scratch(_moved(weights, degree, best, total, turn), "labels")
        reached = _quality(weights, degree, labels, total)
        turn += 1
        if reached > quality + LEAST_GAIN:
            best, quality, idle = labels, reached, 0
        else:
            idle += 1
    return best, quality


def partition(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): communities found by local moves and contraction, level by level, until modularity stops growing.

    Half of the nodes move at a time, so that neighbours do not change places for ever, and a turn that does not gain is taken
    back. Before each contraction communities are split into their connected parts. A hub's links are summed on the map side.
    Labels are node ids; isolated nodes, and all nodes of a graph without edges, are communities of their own. No nodes give no
    rows. The driver reads one number a turn.
    """
    all_nodes = nodes.select("id").distinct()
    weights = scratch(_weights(nodes, edges), "weights")
    total = weights.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return all_nodes.select("id", F.col("id").alias("label"))
    found, reached = scratch(weights.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct(), "found"), None
    while True:
        labels, quality = _level(weights, total)
        if reached is not None and quality <= reached + LEAST_GAIN:
            break
        reached = quality
        labels = _connected(weights, labels)
        found = scratch(found.join(labels.select(F.col("id").alias("label"), F.col("label").alias("above")), "label").select("id", F.col("above").alias("label")), "found")
        up = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        weights = scratch(weights.join(up[0], "src").join(up[1], "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "weights")
    return all_nodes.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _queued_level(weights: DataFrame, degree: DataFrame, start: DataFrame, total: float, seed: int) -> tuple[DataFrame, float]:
    """Local moves from ``start(id, label)``; a turn visits only nodes queued: all at first, then those not dealt yet and the neighbours of what moved.

    (labels, modularity), when the queue is empty or two turns in a row gained nothing.
    """
    best = scratch(start, "labels")
    queue = scratch(best.select("id"), "queue")
    quality, idle, turn = _quality(weights, degree, best, total), 0, 0
    while idle < 2 and not queue.isEmpty():
        dealt = queue.where(F.pmod(F.xxhash64("id", F.lit(turn), F.lit(seed)), F.lit(2)) == 0)
        moved = scratch(_best_labels(weights, degree, best, total, dealt), "moved")
        labels = scratch(best.join(moved, "id", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        reached = _quality(weights, degree, labels, total)
        turn += 1
        if reached > quality + LEAST_GAIN:
            near = weights.where("src <> dst").join(moved.select(F.col("id").alias("src"), "to"), "src").join(labels.withColumnRenamed("id", "dst"), "dst").where("label <> to").select(F.col("dst").alias("id"))
            queue = scratch(queue.join(dealt, "id", "left_anti").unionByName(near).distinct(), "queue")
            best, quality, idle = labels, reached, 0
        else:
            idle += 1
    return best, quality


def _best_labels(weights: DataFrame, degree: DataFrame, labels: DataFrame, total: float, asked: DataFrame) -> DataFrame:
    """(id, to): the neighbouring label of most gain, the least of equals, for those of ``asked`` that gain by it."""
    own = asked.join(labels.withColumnRenamed("label", "own"), "id").join(degree, "id")
    tot = degree.join(labels, "id").groupBy("label").agg(F.sum("k").alias("t"))
    links = weights.where("src <> dst").join(asked.withColumnRenamed("id", "src"), "src", "left_semi").join(labels.withColumnRenamed("id", "dst"), "dst")
    links = links.groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("l")).unionByName(own.select("id", F.col("own").alias("label"), F.lit(0.0).alias("l")))
    at = links.groupBy("id", "label").agg(F.sum("l").alias("l")).join(own, "id").join(tot, "label")
    rest = F.col("t") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
    at = at.withColumn("gain", F.col("l") - F.col("k") * rest / F.lit(total))
    here = F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("here")
    found = at.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("label"))).alias("b"), here)
    return found.where(-F.col("b.g") > F.col("here") + 1e-12).select("id", F.col("b.label").alias("to"))


def _refined(weights: DataFrame, degree: DataFrame, labels: DataFrame, total: float, seed: int) -> DataFrame:
    """(id, sub): each community divided into parts that hang together, named after one of their nodes.

    Nodes begin alone. In a round half of those still alone, dealt by ``seed``, may join a part of their community to which an
    edge leads, if both are well connected to the rest of it and modularity grows; among such parts chance chooses, for more
    gain with more likelihood. No node leaves a part and no part joined in a round moves in it, so every part is connected.
    """
    ends = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    inner = scratch(weights.where("src <> dst").join(ends[0], "src").join(ends[1], "dst").where("a = b").select("src", "dst", "w"), "inner")
    whole = degree.join(labels, "id").groupBy("label").agg(F.sum("k").alias("whole"))
    at = degree.join(labels, "id").join(whole, "label").join(inner.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("out")), "id", "left")
    at = scratch(at.select("id", "k", "whole", (F.coalesce("out", F.lit(0.0)) >= F.col("k") * (F.col("whole") - F.col("k")) / total).alias("fit")), "nodes")
    part = scratch(labels.select("id", F.col("id").alias("sub")), "sub")
    turn = idle = 0
    while idle < 2:
        held = at.join(part, "id")
        across = inner.join(part.select(F.col("id").alias("src"), "sub"), "src").join(part.select(F.col("id").alias("dst"), F.col("sub").alias("other")), "dst").where("sub <> other").groupBy("sub").agg(F.sum("w").alias("out"))
        subs = held.groupBy("sub").agg(F.sum("k").alias("t"), F.count("*").alias("n"), F.first("whole").alias("whole"), F.min("fit").alias("fit")).join(across, "sub", "left")
        mark = F.xxhash64("sub", F.lit(turn), F.lit(seed))
        moves = (F.col("n") == 1) & F.col("fit") & (F.pmod(mark, F.lit(2)) == 0)
        subs = scratch(subs.select("sub", "t", moves.alias("moves"), (F.coalesce("out", F.lit(0.0)) >= F.col("t") * (F.col("whole") - F.col("t")) / total).alias("good")), "subs")
        # a part of one node is named after it
        movers = subs.where("moves").select(F.col("sub").alias("src"), F.col("t").alias("k"))
        near = inner.join(movers, "src").join(part.withColumnRenamed("id", "dst"), "dst").join(subs.where("good and not moves").select("sub", "t"), "sub")
        gain = F.sum("w") - F.first("k") * F.first("t") / total
        near = near.groupBy("src", "sub").agg(gain.alias("gain")).where("gain > 1e-12")
        chance = (F.pmod(F.xxhash64("src", "sub", F.lit(turn), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
        score = F.col("gain") / THETA - F.log(-F.log(chance))
        joined = scratch(near.groupBy(F.col("src").alias("id")).agg(F.max(F.struct(score.alias("s"), "sub")).alias("b")).select("id", F.col("b.sub").alias("to")), "joined")
        turn += 1
        if joined.isEmpty():
            idle += 1
        else:
            part, idle = scratch(part.join(joined, "id", "left").select("id", F.coalesce("to", "sub").alias("sub")), "sub"), 0
    return part


def leiden(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """(id, label): A6a, communities by local moves, refinement inside them, and contraction of the refined parts, until modularity stops growing.

    The contracted graph begins with the communities found, so that parts can change communities together. All communities are
    connected. The same graph and ``seed`` give the same communities. Labels are node ids; isolated nodes, and all nodes of a
    graph without edges, are communities of their own; no nodes give no rows. The driver reads one number a turn.
    """
    all_nodes = nodes.select("id").distinct()
    base = weights = scratch(_weights(nodes, edges), "weights")
    total = weights.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return all_nodes.select("id", F.col("id").alias("label"))
    found = scratch(weights.select(F.col("src").alias("id"), F.col("src").alias("sub")).distinct(), "found")
    start, reached, best = found.select("id", F.col("sub").alias("label")), None, None
    while True:
        degree = scratch(weights.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "degree")
        labels, quality = _queued_level(weights, degree, start, total, seed)
        if reached is not None and quality <= reached + LEAST_GAIN:
            break
        reached = quality
        best = scratch(found.join(labels.withColumnRenamed("id", "sub"), "sub").select("id", "label"), "best")
        part = _refined(weights, degree, labels, total, seed)
        if part.where("id <> sub").isEmpty():
            break
        found = scratch(found.withColumnRenamed("sub", "at").join(part.withColumnRenamed("id", "at"), "at").select("id", "sub"), "found")
        # all nodes of a part are of one community
        start = part.where("id = sub").select("id").join(labels, "id")
        up = part.select(F.col("id").alias("src"), F.col("sub").alias("a")), part.select(F.col("id").alias("dst"), F.col("sub").alias("b"))
        weights = scratch(weights.join(up[0], "src").join(up[1], "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "weights")
    return all_nodes.join(_connected(base, best), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def modularity_of(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of ``labels(id, label)`` on the pairs of linked nodes, 0 without edges."""
    weights = _weights(nodes, edges)
    total = weights.agg(F.sum("w")).first()[0] or 0.0
    return _quality(weights, weights.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), labels, total) if total else 0.0


def loose_communities(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label): the communities that are not connected, which neither algorithm leaves."""
    parts = _connected(_weights(nodes, edges), labels).withColumnRenamed("label", "part")
    linked = labels.join(parts, "id", "left").groupBy("label").agg(F.countDistinct(F.coalesce("part", "id")).alias("n"))
    return linked.where("n > 1").select("label")
