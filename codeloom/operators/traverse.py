"""Traversals over (src, dst) edges by frontier joins (rows Q2-Q13, Q7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import base_name, normal_path
from codeloom.session import dealt, scratch


def flipped(edges: DataFrame) -> DataFrame:
    """Edges the other way round."""
    return edges.select(*[F.col("dst").alias("src") if c == "src" else F.col("src").alias("dst") if c == "dst" else F.col(c) for c in edges.columns])


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the edges, written once for all levels of a search."""
    return scratch(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "pairs")


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, hops): nodes reached from ``start(id)`` along edges, the start itself at 0; cycles are fine.

    One join of the edges with the frontier a level and an anti-join with what was reached before, until nothing new is
    met or ``max_depth`` is. The edges are written once, each level once, and what was reached is gathered into one table
    every few levels, so that neither lineage nor the number of tables read grows with the depth.
    """
    pairs = _pairs(edges)
    front = scratch(start.select("id").distinct().withColumn("hops", F.lit(0)), "reach")
    seen = front
    hops = 0
    while max_depth is None or hops < max_depth:
        hops += 1
        step = pairs.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = scratch(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(hops)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hops % 8 == 0:
            seen = scratch(seen, "reach")
    return seen


def dependencies(edges: DataFrame, subject: str, limit: int = 20, reverse: bool = False) -> DataFrame:
    """Q2, Q3: up to ``limit`` nodes in breadth-first order with the relation by which each was first met.

    A level's order is that of the parent, then of the edge's ord. As no more than ``limit`` nodes are wanted, the frontier
    holds ``limit`` at most: each level is one filtered scan with a top-k, not a join.
    """
    e = (flipped(edges) if reverse else edges).select("src", "dst", "relation", "ord")
    spark = edges.sparkSession
    found: list[tuple] = []
    seen, front = [subject], [subject]
    while front and len(found) < limit:
        rank = spark.createDataFrame([(n, i) for i, n in enumerate(front)], "src string, parent long")
        step = e.where(F.col("src").isin(front) & ~F.col("dst").isin(seen)).join(F.broadcast(rank), "src")
        first = step.groupBy("dst").agg(F.min(F.struct("parent", "ord", "relation")).alias("f"))
        rows = first.orderBy("f.parent", "f.ord", "dst").limit(limit - len(found)).collect()
        front = [r.dst for r in rows]
        seen += front
        found += [(len(found) + i + 1, r.dst, r.f.relation) for i, r in enumerate(rows)]
    return spark.createDataFrame(found, "position int, id string, relation string")


def impact(edges: DataFrame, subject: str) -> DataFrame:
    """Q7: (id, hops) of every node with a path to ``subject``; one reverse search."""
    start = edges.sparkSession.createDataFrame([(subject,)], "id string")
    return reachable(flipped(edges), start).where(F.col("hops") > 0)


def impact_paths(edges: DataFrame, subject: str) -> DataFrame:
    """Q7: (id, hops, path) of every node with a path to ``subject``: the lexicographically least of its shortest ones, its ends included.

    The reverse search carries a path a node: of the neighbours a hop nearer, the least path, a grouped minimum. A row is as
    long as its path.
    """
    pairs = _pairs(edges)
    front = edges.sparkSession.createDataFrame([(subject, [subject])], "id string, path array<string>")
    seen, found, hops = front.select("id"), None, 0
    while True:
        hops += 1
        step = pairs.join(front.withColumnRenamed("id", "dst"), "dst").join(seen.withColumnRenamed("id", "src"), "src", "left_anti")
        step = step.groupBy(F.col("src").alias("id")).agg(F.min("path").alias("rest")).select("id", F.lit(hops).alias("hops"), F.concat(F.array("id"), F.col("rest")).alias("path"))
        level = scratch(step, "impact")
        if level.isEmpty():
            return found if found is not None else level
        front = level.select("id", "path")
        seen = seen.unionByName(level.select("id"))
        found = level if found is None else found.unionByName(level)
        if hops % 8 == 0:
            seen, found = scratch(seen, "impact"), scratch(found, "impact")


def _next(pairs: DataFrame, front: DataFrame, at: str, to: str) -> DataFrame:
    """(id): the nodes at the end ``to`` of the pairs whose end ``at`` is in front(id)."""
    return pairs.join(front.select(F.col("id").alias(at)), at).select(F.col(to).alias("id")).distinct()


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Q8, Q10: (hop, id) of the shortest path, the lexicographically least of them; no rows if there is none.

    Levels grow from both ends, always at the one whose last level has fewer nodes, until they meet, so that a wide end is not
    searched through. Of the levels the nodes that lead from one end to the other are kept; the path is then read hop by hop, a
    top-1 of the edges between two levels each time.
    """
    spark = edges.sparkSession
    schema = "hop int, id string"
    if source == target:
        return spark.createDataFrame([(0, source)], schema)
    pairs = _pairs(edges)
    ends = ("src", "dst")
    levels = [[scratch(spark.createDataFrame([(x,)], "id string"), "path")] for x in (source, target)]
    seen, sizes = [own[0] for own in levels], [1, 1]
    while True:
        k = 0 if sizes[0] <= sizes[1] else 1
        own = levels[k]
        step = _next(pairs, own[-1], ends[k], ends[1 - k])
        front = scratch(step.join(seen[k], "id", "left_anti"), "path")
        sizes[k] = front.count()
        if not sizes[k]:
            return spark.createDataFrame([], schema)
        own.append(front)
        seen[k] = scratch(seen[k].unionByName(front), "path") if len(own) % 8 == 0 else seen[k].unionByName(front)
        met = scratch(front.join(levels[1 - k][-1], "id", "left_semi"), "path")
        if not met.isEmpty():
            break
    # from where they met back to the source, and on to the target
    on_way = [met]
    for level in reversed(levels[0][:-1]):
        on_way.insert(0, scratch(_next(pairs, on_way[0], "dst", "src").join(level, "id", "left_semi"), "path"))
    for level in reversed(levels[1][:-1]):
        on_way.append(scratch(_next(pairs, on_way[-1], "src", "dst").join(level, "id", "left_semi"), "path"))
    path = [source]
    for level in on_way[1:]:
        nxt = pairs.where(F.col("src") == path[-1]).join(level.select(F.col("id").alias("dst")), "dst", "left_semi").agg(F.min("dst")).first()[0]
        path.append(nxt)
    return spark.createDataFrame(list(enumerate(path)), schema)


# What a file's path adds to its rank as a neighbour.
STARTS_WITH = {"cmd/": 50, "apps/mobile/": 15, "apps/desktop-pos/": 10, "apps/web-portal/": -5}
ANY_OF = [(("/server/", "/auth/"), 40), (("/presentation/", "/shared/contexts/"), 35)]
EACH_OF = [
    (("context", "hook", "service", "domain", "reader", "main.go", "server.go"), 20),
    (("/domain/", "/kitchen/", "/dashboard/"), -15),
    (("_test.go", ".spec.", ".test.", "/components/", "/page.tsx", "/index.tsx"), -25),
]
TEST_MARKS = ("_test.go", ".test.", ".spec.", "bench")
STATIC_ORIGINS = ("static_import", "workspace_package")


def _points(condition: Column, n: int) -> Column:
    return F.when(condition, n).otherwise(0)


def file_score(path: Column, static: Column) -> Column:
    """Q5."""
    p = normal_path(path)
    score = _points(static, 100)
    for mark, n in STARTS_WITH.items():
        score = score + _points(p.startswith(mark), n)
    for marks, n in ANY_OF:
        hit = F.lit(False)
        for m in marks:
            hit = hit | p.contains(m)
        score = score + _points(hit, n)
    for marks, n in EACH_OF:
        for m in marks:
            score = score + _points(p.contains(m), n)
    return score


def barrel_root(path: Column) -> Column:
    """Q6: packages/<...>/ of a package's index file, else empty."""
    return F.regexp_replace(F.regexp_extract(normal_path(path), r"(?s)^(packages/.+)/src/index\.(?:ts|tsx|js|jsx)$", 1), r"(?s)^(.+)$", "$1/")


def file_dependencies(nodes: DataFrame, edges: DataFrame, subjects: DataFrame, limit: int = 20, reverse: bool = False) -> DataFrame:
    """Q4: for each ``subjects(subject)``, its ranked neighbour files: (subject, position, id, relation, score).

    The first edge of each neighbour counts. Static ones alone if there are any; without tests if two others remain;
    for callers of a package's index, those outside it if there are two. By score, then label.
    """
    e = flipped(edges) if reverse else edges
    files = nodes.where("kind = 'file'").select("id", "label", "file")
    n = files.withColumnsRenamed({"id": "dst", "label": "dst_label", "file": "dst_file"})
    s = files.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
    # written and counted, so that tables grow in tasks and not in what a task holds
    e = scratch(e.where("relation <> 'contains'").select("src", "dst", "ord", "relation", "projected_from"), "neighbour-edges")
    rows = e.count()
    e = dealt(e, rows, "src").join(dealt(subjects.select(F.col("subject").alias("src")).distinct(), rows, "src"), "src", "left_semi")
    first = e.groupBy("src", "dst").agg(F.min(F.struct("ord", "relation", "projected_from")).alias("f")).join(dealt(s, rows, "src"), "src")
    c = dealt(first, rows, "dst").join(dealt(n, rows, "dst"), "dst").select("src", "src_file", "dst", "dst_label", "dst_file", "f.relation", F.coalesce(F.col("f.projected_from").isin(*STATIC_ORIGINS), F.lit(False)).alias("static"))
    path = normal_path(F.col("dst_file"))
    test = F.lit(False)
    for m in TEST_MARKS:
        test = test | path.contains(m)
    root = barrel_root(F.col("src_file"))
    c = c.withColumns({"test": test, "outside": (F.lit(reverse) & (root != "") & ~path.startswith(root)), "score": file_score(F.col("dst_file"), F.col("static"))})
    # all rules from one set of grouped counts: what a rule sees depends only on whether the ones before it applied
    c = dealt(scratch(c, "neighbour-files"), rows, "src")
    plain = ~F.col("test")
    seen = {"s": F.col("static"), "a": F.lit(True)}
    counts = [F.max("static").alias("any_static")]
    for k, own in seen.items():
        counts += [F.count_if(own & plain).alias(f"plain_{k}"), F.count_if(own & F.col("outside")).alias(f"outside_{k}"), F.count_if(own & plain & F.col("outside")).alias(f"outside_plain_{k}")]
    c = c.join(c.groupBy("src").agg(*counts), "src")
    by = lambda name: F.when(F.col("any_static"), F.col(f"{name}_s")).otherwise(F.col(f"{name}_a"))
    untested = by("plain") >= 2
    outer = F.when(untested, by("outside_plain")).otherwise(by("outside"))
    c = c.where((F.col("static") | ~F.col("any_static")) & (plain | ~untested) & (F.col("outside") | (outer < 2)))
    order = F.struct((-F.col("score")).alias("a"), F.col("dst_label").alias("b"), F.col("dst").alias("c"), F.col("relation").alias("r"))
    # the k least of each subject: partial windows keep k rows a task and subject before the shuffle
    from pyspark.sql import Window

    c = c.withColumn("position", F.row_number().over(Window.partitionBy("src").orderBy(order))).where(F.col("position") <= limit)
    return c.select(F.col("src").alias("subject"), "position", F.col("dst").alias("id"), "relation", "score")


def path_root(path: Column) -> Column:
    """Q12: three segments under packages/, two under internal/ or cmd/, else the directory."""
    p = normal_path(path)
    return (
        F.when(p == "", "")
        .when(p.rlike("^packages/[^/]*/"), F.concat(F.substring_index(p, "/", 3), F.lit("/")))
        .when(p.rlike("^packages/[^/]*$"), F.lit("packages/"))
        .when(p.rlike("^(internal|cmd)/"), F.concat(F.substring_index(p, "/", 2), F.lit("/")))
        .otherwise(F.regexp_extract(p, r"(?s)^(.*/)[^/]*$", 1))
    )


# What an inner file of a path adds to the path's rank, and what the path itself does.
INSIDE_TARGET, INDEX_FILE, CONFIG_FILE, TYPES_FILE = 40, 30, 25, 10
INSIDE_SOURCE, DOMAIN_FOLDER, CONTEXT_FOLDER = 20, 15, 10
INDIRECT, ALL_INSIDE = 10, 20
#: Files of a path beyond the shortest one, and at most.
LONGER, MOST_FILES = 3, 8


def inner_score(file: Column, source: Column, target: Column) -> Column:
    """Q11: what one inner file adds, given the roots of the path's ends."""
    p = normal_path(file)
    base = base_name(p)
    context = p.contains("/context/") & ~p.contains("/presentation/context/") & ~p.contains("/shared/contexts/")
    return (
        _points((target != "") & p.startswith(target), INSIDE_TARGET)
        + _points(base.startswith("index."), INDEX_FILE)
        + _points(base == "config.go", CONFIG_FILE)
        + _points(base == "types.go", TYPES_FILE)
        - _points((source != "") & (target != "") & (source != target) & p.startswith(source), INSIDE_SOURCE)
        - _points(p.contains("/domain/"), DOMAIN_FOLDER)
        - _points(context, CONTEXT_FOLDER)
    )


def path_score(files: Column) -> Column:
    """Q11: score of a path given as the array of its nodes' files, in order; by higher-order functions alone."""
    n = F.size(files)
    source, target = path_root(F.element_at(files, 1)), path_root(F.element_at(files, -1))
    inner = F.when(n > 2, F.slice(files, 2, F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    total = F.aggregate(inner, F.lit(0), lambda a, f: a + inner_score(f, source, target))
    all_in = (n > 2) & F.forall(inner, lambda f: (target != "") & normal_path(f).startswith(target))
    return F.when(n < 2, 0).otherwise(total - n + _points(n > 2, INDIRECT) + _points(all_in, ALL_INSIDE))


def ranked_file_path(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """Q9, Q13: the best-scored simple path of at most min(shortest + 3, 8) files: (hop, id), no rows without a path.

    Labels are set level by level: of all walks to a node with as many files, whose inner files all lie under the target's root or
    do not, only the one of best score is kept, of equal ones the lexicographically least; a grouped minimum. So a level holds two
    labels a node, however many paths there are. A walk may meet a node twice. If the best one does, its repeated nodes become
    critical: labels then also tell which critical nodes they have met and meet none again, and all is done anew. From the second
    time on, labels are left out that cannot reach the best simple path found so far: the most that walks back from the target
    can add bounds what the rest of a path adds. Ties: the shorter, then the lexicographically least path.
    """
    spark = nodes.sparkSession
    if source == target:
        known = nodes.where((F.col("kind") == "file") & (F.col("id") == source))
        return known.select(F.lit(0).alias("hop"), "id").limit(1)
    files = nodes.where("kind = 'file'").select("id", "file")
    ends = edges.where("relation <> 'contains'").select("src", "dst").distinct()
    pairs = scratch(ends.join(files.select(F.col("id").alias("src")), "src", "left_semi").join(files.select(F.col("id").alias("dst")), "dst", "left_semi"), "file-pairs")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    ahead = reachable(pairs, one(source), MOST_FILES - 1)
    behind = reachable(flipped(pairs), one(target), MOST_FILES - 1)
    gap = ahead.where(F.col("id") == target).agg(F.min("hops")).first()[0]
    if gap is None:
        return spark.createDataFrame([], "hop int, id string")
    most = min(gap + 1 + LONGER, MOST_FILES)
    # what lies ahead of the source and behind the target, within the files that are left
    room = ahead.select("id", F.col("hops").alias("a")).join(behind.select("id", F.col("hops").alias("b")), "id").where(F.col("a") + F.col("b") < most)
    of = {r.id: r.file for r in files.where(F.col("id").isin(source, target)).collect()}
    roots = spark.range(1).select(path_root(F.lit(of[source])).alias("s"), path_root(F.lit(of[target])).alias("t")).first()
    near = pairs.join(room.select(F.col("id").alias("src")), "src", "left_semi").join(room.select(F.col("id").alias("dst"), "b"), "dst").join(files.withColumnRenamed("id", "dst"), "dst")
    inside = F.lit(roots.t != "") & normal_path(F.col("file")).startswith(F.lit(roots.t))
    near = near.where(F.col("dst") != source).select("src", "dst", "b", inner_score(F.col("file"), F.lit(roots.s), F.lit(roots.t)).alias("w"), inside.alias("in"))
    near = scratch(near, "near")
    critical: list[str] = []
    least = bounds = None
    while True:
        best, simple = _best_walk(near, source, target, most, critical, bounds, least)
        if simple is not None and (least is None or simple > least):
            least = simple
        if len(set(best)) == len(best):
            return spark.createDataFrame(list(enumerate(best)), "hop int, id string")
        critical = sorted({*critical, *(x for x in best if best.count(x) > 1)})
        bounds = bounds if bounds is not None else _rest_bounds(near, target, most)


def _best_walk(near: DataFrame, source: str, target: str, most: int, critical: list[str], bounds: DataFrame | None, least: int | None) -> tuple[list[str], int | None]:
    """(the best walk that meets no critical node twice, the score of the best simple one among those that ended)."""
    spark = near.sparkSession
    labels = spark.createDataFrame([(source, [], True, 0, [source])], "src string, met array<string>, inside boolean, score int, path array<string>")
    ended = None
    is_critical = F.col("dst").isin(critical) if critical else F.lit(False)
    for n in range(2, most + 1):
        grown = labels.join(near, "src").where((F.col("b") + n <= most) & ~F.array_contains("met", F.col("dst")))
        path = F.array_append("path", F.col("dst"))
        final = F.col("score") - n + (F.lit(INDIRECT) + _points(F.col("inside"), ALL_INSIDE) if n > 2 else F.lit(0))
        there = grown.where(F.col("dst") == target).select(final.alias("score"), F.lit(n).alias("n"), path.alias("path"))
        ended = there if ended is None else ended.unionByName(there)
        if n == most:
            break
        step = grown.where(F.col("dst") != target).select(
            F.col("dst").alias("src"), F.when(is_critical, F.array_sort(F.array_append("met", F.col("dst")))).otherwise(F.col("met")).alias("met"), (F.col("inside") & F.col("in")).alias("inside"), (F.col("score") + F.col("w")).alias("score"), path.alias("path")
        )
        kept = step.groupBy("src", "met", "inside").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"))).alias("k"))
        labels = kept.select("src", "met", "inside", (-F.col("k.s")).cast("int").alias("score"), F.col("k.p").alias("path"))
        if bounds is not None and least is not None:
            rest = bounds.where(F.col("hops") <= most - n).groupBy("src").agg(F.max(F.col("rest") - F.col("hops")).alias("rest"))
            reach = F.col("score") + F.col("rest") - n + INDIRECT + _points(F.col("inside"), ALL_INSIDE)
            labels = labels.join(rest, "src").where(reach >= least).drop("rest")
        labels = scratch(labels, "walk-labels")
    ended = scratch(ended, "walks-ended")
    best = ended.agg(F.min(F.struct((-F.col("score")).alias("s"), "n", "path")).alias("b")).first().b
    simple = ended.where(F.size(F.array_distinct("path")) == F.size("path")).agg(F.max("score")).first()[0]
    return list(best.path), simple


def _rest_bounds(near: DataFrame, target: str, most: int) -> DataFrame:
    """(src, hops, rest): the most that the inner files of a walk of so many hops from src to the target can add."""
    now = near.where(F.col("dst") == target).select("src", F.lit(1).alias("hops"), F.lit(0).alias("rest")).distinct()
    every = now
    for h in range(2, most):
        back = near.where(F.col("dst") != target).join(now.select(F.col("src").alias("dst"), "rest"), "dst")
        now = scratch(back.groupBy("src").agg(F.max(F.col("rest") + F.col("w")).alias("rest")).select("src", F.lit(h).alias("hops"), "rest"), "rest")
        every = every.unionByName(now)
    return scratch(every, "rest")
