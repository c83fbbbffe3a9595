"""Graph algebra on edge DataFrames with columns src, dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import fixpoint, forget, settle


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


def inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetric_closure(edges: DataFrame) -> DataFrame:
    return edges.union(inverse(edges)).distinct()


def transitive_closure(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Pairs joined by a path of one edge or more; a vertex reaches itself only on a cycle.

    Strongly connected components are contracted first, so that rounds run over the condensation alone; at the end each
    pair of components stands for all pairs of their members, which are the rows of the result."""
    edges = settle(edges.select("src", "dst").distinct())
    labels = settle(_scc(edges) if labels is None else labels)
    both = edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst")
    hops = settle(both.select("a", "b").distinct())
    steps = hops.filter("a <> b").toDF("mid", "b")
    pairs = fixpoint(hops, lambda new: new.toDF("a", "mid").join(steps, "mid").select("a", "b"))
    return _spread(pairs, labels)


#: Most rows of either side of a cell of a result that is a product: a task makes their square, and copies of the sides are as many as the result's rows by this number.
CELL = 4_000


def _spread(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst: the members of a with those of b, for each of pairs(a, b)."""
    sizes = settle(labels.groupBy(F.col("component").alias("a")).agg(F.count(F.lit(1)).alias("n")))
    reached = pairs.join(sizes.toDF("b", "n"), "b").groupBy("a").agg(F.sum("n").alias("m"))
    return _crossed(labels.toDF("src", "a"), pairs.join(labels.toDF("dst", "b"), "b").select("a", "dst"), sizes.join(reached, "a"))


def _crossed(left: DataFrame, right: DataFrame, sizes: DataFrame) -> DataFrame:
    """x, y: all rows of left(x, a) with all rows of right(a, y) of one a, of which sizes(a, n, m) tells how many each side has.

    Both sides are cut into cells, which are dealt to as many tasks as the result's rows need: adaptive execution
    would put these few rows together for one task. Only the sides are shuffled, never the rows of the result."""
    spark, (x, y) = left.sparkSession, (next(c for c in side.columns if c != "a") for side in (left, right))
    cut = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    cells = settle(sizes.select("a", "n", "m", cut("n").alias("rows"), cut("m").alias("columns")))
    made = cells.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(made // CELL**2))
    part = lambda of, parts: F.pmod(F.xxhash64(of), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = left.join(cells, "a").select("a", x, part(x, "rows").alias("i"), every("columns").alias("j"))
    right = right.join(cells, "a").select("a", y, every("rows").alias("i"), part(y, "columns").alias("j"))
    where = ["a", "i", "j"]
    return left.repartition(n, *where).join(right.repartition(n, *where), where).select(x, y)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Vertices reachable from any of `seeds` (column v), seeds included."""
    hop = settle(edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).distinct())
    return fixpoint(seeds.select("v"), lambda new: new.join(hop, "v").select(F.col("w").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """v, component: the smallest vertex of each weakly connected component, by contracting edges to smallest neighbours."""
    labels = settle(vertices(edges).withColumn("component", F.col("v")))
    edges = settle(edges.filter("src <> dst").select("src", "dst").distinct())
    while not edges.isEmpty():
        parent = symmetric_closure(edges).groupBy("src").agg(F.min("dst").alias("p")).select(F.col("src").alias("x"), F.least("src", "p").alias("p"))
        parent = settle(parent)
        labels = settle(labels.join(parent, labels.component == parent.x, "left").select("v", F.coalesce("p", "component").alias("component")))
        moved = edges.join(parent.toDF("src", "ps"), "src").join(parent.toDF("dst", "pd"), "dst").filter("ps <> pd")
        edges = settle(moved.select(F.col("ps").alias("src"), F.col("pd").alias("dst")).distinct())
    return labels


def _dead_ends(edges: DataFrame) -> DataFrame:
    """src: vertices from which single edges lead, one after the other, to a vertex without any. Pointers double from round to round."""
    at = settle(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("p")).filter("n = 1").select("src", "p"))
    for _ in range(at.count().bit_length()):  # a way of single edges is no longer than that, unless it is a cycle
        far = at.toDF("p", "far")
        after = settle(at.join(far, "p", "left").select("src", F.coalesce("far", "p").alias("p"), F.col("far").isNotNull().alias("moved")))
        forget(at)
        at = after.select("src", "p")
        at._settled_in = after._settled_in
        if after.filter("moved").isEmpty():
            break
    return at.join(edges.select(F.col("src").alias("p")).distinct(), "p", "left_anti").select("src")


def _trimmed(edges: DataFrame, passes: int = 2) -> DataFrame:
    """Edges without many that are on no cycle: those from a vertex that none reaches, or to one that reaches none, some times over, and then those on chains that end so.

    The vertices to keep are found first, so that edges are not shuffled where vertices are few, and not written again where all stay."""
    given = edges
    for _ in range(passes):
        ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("dst", F.lit(0), F.lit(1)))
        ends = settle(ends.groupBy("v").agg((F.max("out") + F.max("into") == 2).alias("inner")))
        if ends.filter("NOT inner").isEmpty():
            forget(ends)
            return edges
        inner = ends.filter("inner").select("v")
        left = settle(edges.join(inner.toDF("src"), "src", "left_semi").join(inner.toDF("dst"), "dst", "left_semi").select("src", "dst"))
        forget(ends, *([] if edges is given else [edges]))
        edges = left
        if edges.isEmpty():
            return edges
    edges = settle(edges.join(_dead_ends(edges), "src", "left_anti").select("src", "dst"))
    return settle(edges.join(_dead_ends(inverse(edges)).toDF("dst"), "dst", "left_anti").select("src", "dst"))


def _least_reaching(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """v, c: the smallest c of all vertices of ranked(v, c) that reach v, c being struct(rank, v).

    What reaches c's vertex reaches v as well, so a vertex takes over the c of its c: chains and cycles halve from round to round."""
    held = settle(ranked.withColumn("new", F.lit(True)))
    while True:
        pushed = held.filter("new").join(edges, F.col("v") == F.col("src")).groupBy("dst").agg(F.min("c").alias("m"))
        after = held.join(pushed, F.col("v") == F.col("dst"), "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        far = held.select(F.col("v").alias("at"), F.col("c").alias("far"))
        after = after.join(far, F.col("c.v") == F.col("at"), "left").select("v", F.least("c", F.coalesce("far", "c")).alias("c"), "old")
        after = settle(after.select("v", "c", (F.col("c") < F.col("old")).alias("new")))
        forget(held)
        held = after
        if held.filter("new").isEmpty():
            return held.select("v", "c")


def scc(edges: DataFrame) -> DataFrame:
    """v, component: the smallest vertex of each strongly connected component.

    Vertices get ranks by a hash. Each learns the first-ranked vertex that reaches it and the first-ranked one that it reaches: where they
    are the same, that vertex's component is found; edges whose ends learn differently join no component, and go; the rest is ranked anew.
    Both are found in rounds by the logarithm of the longest way, and so many rankings split a graph, chains too, whatever its ids."""
    return _scc(settle(edges.select("src", "dst").distinct()))


def _scc(edges: DataFrame) -> DataFrame:
    """scc() of edges that are distinct and settled."""
    all_ = settle(vertices(edges))
    left, found, turn = edges.filter("src <> dst"), None, 0
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        ranked = settle(vertices(left).select("v", F.struct(F.xxhash64(F.col("v"), F.lit(turn)).alias("rank"), "v").alias("c")))
        above, below = _least_reaching(left, ranked), _least_reaching(inverse(left), ranked)
        known = settle(above.join(below.toDF("v", "d"), "v"))
        here = known.filter("c = d").select("v", F.col("c.v").alias("c"))
        found = settle(here if found is None else found.union(here))
        open_ = known.filter("c <> d")
        left = left.join(open_.toDF("src", "c", "d"), "src").join(open_.toDF("dst", "e", "f"), "dst").filter("c = e and d = f")
        left, turn = settle(left.select("src", "dst")), turn + 1
        forget(ranked, known)
    if found is None:
        return all_.withColumn("component", F.col("v"))
    least = found.groupBy("c").agg(F.min("v").alias("component"))
    return all_.join(found.join(least, "c").select("v", "component"), "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def condensation(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Edges between strongly connected components."""
    labels = settle(scc(edges) if labels is None else labels)
    both = edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").filter("a <> b")
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def levels(dag: DataFrame, all_vertices: DataFrame) -> DataFrame:
    """v, level: longest path to a sink of an acyclic graph; ascending levels are a bottom-up order. Each round takes the sinks off."""
    left, open_, out, level = settle(dag.select("src", "dst").distinct()), settle(all_vertices.select("v").distinct()), None, 0
    while not open_.isEmpty():
        inner = settle(left.select(F.col("src").alias("v")).distinct())
        sinks = open_.join(inner, "v", "left_anti").select("v", F.lit(level).alias("level"))
        out = settle(sinks if out is None else out.union(sinks))
        if inner.isEmpty():
            break
        left = settle(left.join(inner.toDF("dst"), "dst", "left_semi").select("src", "dst"))
        open_, level = inner, level + 1
    return all_vertices.select("v", F.lit(0).alias("level")).limit(0) if out is None else out


def merge_weighted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst, weight: weighted edges between components, each weight once; labels(v, component), others stand for themselves."""
    a, b = labels.toDF("src", "a"), labels.toDF("dst", "b")
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    return both.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "weight").distinct()


def reaching(edges: DataFrame, facts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """v, fact: every fact(v, fact) of a vertex and of all that it reaches. Facts climb the condensation from round to round, so pairs of vertices are never made.

    At the end the members of a component meet its facts in cells, as in transitive_closure(): each pair is made once, so the result is not shuffled. labels(v, component)
    have each vertex once."""
    labels = settle(scc(edges) if labels is None else labels)
    up = settle(condensation(edges, labels).select(F.col("dst").alias("c"), F.col("src").alias("up")))
    own = facts.join(labels, "v", "left").select(F.coalesce("component", "v").alias("c"), "fact")
    found = fixpoint(own, lambda new: new.join(up, "c").select(F.col("up").alias("c"), "fact")).withColumnRenamed("c", "a")
    members = settle(labels.union(facts.select("v", F.col("v").alias("component")).join(labels, "v", "left_anti")).distinct().toDF("v", "a"))
    count = lambda rows, name: rows.groupBy("a").agg(F.count(F.lit(1)).alias(name))
    return _crossed(members, found, count(members, "n").join(count(found, "m"), "a"))


def simple_paths(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """All simple paths from `seeds`, of up to `most` edges if that is given: src, dst, path (as text), n (edges)."""
    hop = settle(edges.select(F.col("src").alias("dst"), F.col("dst").alias("far")).distinct())
    level = settle(seeds.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.array("v").alias("path")))
    out = level.limit(0)
    n = 0
    while most is None or n < most:
        level = settle(level.join(hop, "dst").filter(~F.array_contains("path", F.col("far"))).select("src", F.col("far").alias("dst"), F.array_append("path", F.col("far")).alias("path")))
        if level.isEmpty():
            break
        out, n = out.unionByName(level), n + 1
    return out.select("src", "dst", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"), (F.size("path") - 1).alias("n"))


def _search_tree(hop: DataFrame, entry: DataFrame) -> DataFrame:
    """v, above: the vertices that a breadth-first search from `entry` passes on its way to v, v included; of equally short ways the one of the smallest predecessor."""
    known = level = settle(entry.select("v").distinct().select("v", F.array("v").alias("above")))
    parts = [known]
    while True:
        found = level.join(hop, "v").groupBy("w").agg(F.min_by("above", "v").alias("above"))
        found = found.select(F.col("w").alias("v"), F.array_append("above", F.col("w")).alias("above"))
        level = settle(found.join(known, "v", "left_anti"))
        if level.isEmpty():
            return known
        known, parts = known.union(level), [*parts, level]
        if len(parts) == 8:  # the newest level is read once more
            known = settle(known)
            forget(*parts[:-1])
            parts = [known]


def dominators(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """d, v: d lies on every path from the one `entry` vertex to v (v dominates itself); only reachable vertices.

    What lies on every path lies on the shortest one, so the candidates of v are the vertices above it in a search tree. A candidate goes when
    a predecessor of v has it as none, until all predecessors agree: rows grow with edges times depth, not with pairs of vertices."""
    return _dominators(settle(edges.select("src", "dst").distinct()), entry)


def _dominators(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """dominators() of edges that are settled."""
    entry = settle(entry.select("v").distinct())
    if entry.limit(2).count() != 1:
        raise ValueError("dominators need exactly one entry")
    hop = edges.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    tree = settle(_search_tree(hop, entry))
    candidates = settle(tree.select(F.explode("above").alias("d"), "v"))
    into = settle(hop.join(tree, "v", "left_semi").select(F.col("v").alias("p"), F.col("w").alias("v")))
    asked = candidates.filter("d <> v").join(into, "v")
    refused = asked.join(candidates.toDF("d", "p"), ["d", "p"], "left_anti").select("d", "v")
    step = lambda new: new.toDF("d", "p").join(into, "p").filter("d <> v").select("d", "v").join(candidates, ["d", "v"], "left_semi")
    return candidates.join(fixpoint(refused, step), ["d", "v"], "left_anti")


def back_edges(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """Edges whose target dominates their source."""
    return _back_edges(settle(edges.distinct()), entry)


def _back_edges(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """back_edges() of edges that are distinct and settled."""
    return edges.join(_dominators(edges, entry).toDF("dst", "src"), ["src", "dst"], "left_semi")


def loop_bodies(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """head, v: the vertices of each natural loop, its head included: those that reach a back edge's source without passing the head."""
    edges = settle(edges.select("src", "dst").distinct())
    back = settle(_back_edges(edges, entry).select(F.col("dst").alias("head"), F.col("src").alias("v")))
    before = edges.select(F.col("dst").alias("v"), F.col("src").alias("u"))
    found = fixpoint(back.union(back.select("head", F.col("head"))), lambda new: new.filter("v <> head").join(before, "v").select("head", F.col("u").alias("v")))
    return found


def live_in(edges: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """block, name: what may be read from a block's start on before it is set anew. uses(block, name): read before any setting in the block; defs(block, name)."""
    before = settle(edges.select(F.col("dst").alias("block"), F.col("src").alias("up")).distinct())
    defs = settle(defs.select("block", "name").distinct())
    return fixpoint(uses.select("block", "name"), lambda new: new.join(before, "block").select(F.col("up").alias("block"), "name").join(defs, ["block", "name"], "left_anti"))


def live_out(edges: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """block, name: what may be read after a block before it is set anew, that is at the start of a block that follows."""
    before = edges.select(F.col("dst").alias("block"), F.col("src").alias("up")).distinct()
    return live_in(edges, uses, defs).join(before, "block").select(F.col("up").alias("block"), "name").distinct()


def dead_names(blocks: DataFrame, names: DataFrame, live: DataFrame, kept: DataFrame) -> DataFrame:
    """block, name: names(fn, name) of each of blocks(fn, block) that live(block, name), from live_in(), does not have, nor kept(fn, name): what is borrowed, or returned."""
    return blocks.join(names.join(kept, ["fn", "name"], "left_anti"), "fn").select("block", "name").join(live, ["block", "name"], "left_anti")


def join_points(edges: DataFrame) -> DataFrame:
    """v, n_preds: vertices with more than one predecessor."""
    return edges.groupBy(F.col("dst").alias("v")).agg(F.count_distinct("src").alias("n_preds")).filter("n_preds > 1")
