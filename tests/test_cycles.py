"""Strong components of long chains and cycles, and points-to sets of slots that copy each other in cycles."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import fixpoint, graph, pointsto


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def writes(monkeypatch):
    """Counts the tables that are written."""
    count, real = [0], fixpoint.settle

    def settle(df):
        count[0] += 1
        return real(df)

    for module in (fixpoint, graph, pointsto):
        monkeypatch.setattr(module, "settle", settle)
    return count


def test_long_cycle_and_long_chain(spark, writes):
    """A cycle of 1,000 vertices and a chain of 1,000, in an order that has nothing to do with their ids."""
    ids = list(range(2000))
    random.Random(1).shuffle(ids)
    ring, chain = ids[:1000], ids[1000:]
    edges = list(zip(ring, [*ring[1:], ring[0]])) + list(zip(chain, chain[1:])) + [(ring[5], chain[0])]
    out = dict(rows(graph.scc(spark.createDataFrame(edges, "src long, dst long"))))
    assert {out[v] for v in ring} == {min(ring)} and all(out[v] == v for v in chain)
    assert writes[0] < 200


def test_components_of_random_graphs(spark):
    r = random.Random(5)
    edges = sorted({(g * 100 + r.randrange(20), g * 100 + r.randrange(20)) for g in range(12) for _ in range(8 + 3 * g)})
    succ = {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            new = succ.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    reached = {v: reach(v) for v in {v for e in edges for v in e}}
    expected = [(v, min(w for w in reached[v] if v in reached[w])) for v in sorted(reached)]
    assert rows(graph.scc(spark.createDataFrame(edges, "src long, dst long"))) == expected
    assert len({c for _, c in expected}) > 40


def test_closure_of_a_large_component(spark):
    n = 150
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).union(spark.createDataFrame([(3, 1000), (1000, 1001)], "src long, dst long"))
    assert graph.transitive_closure(edges).count() == n * (n + 2) + 1


def test_closure_is_dealt_to_tasks(spark, monkeypatch):
    """A component of 150: its 22,500 pairs are made by many tasks, each a part of them, though its members are few."""
    monkeypatch.setattr(graph, "CELL", 20, raising=False)
    n = 150
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).union(spark.createDataFrame([(3, 1000), (1000, 1001), (2000, 3), (5000, 5000)], "src long, dst long"))
    made = graph.transitive_closure(edges).withColumn("task", F.spark_partition_id())
    assert made.count() == made.select("src", "dst").distinct().count() == n * (n + 2) + 1 + (n + 2) + 1
    by_task = [c for _, c in rows(made.groupBy("task").count())]
    assert len(by_task) > 20 and max(by_task) < n * n // 4


def test_nothing_to_trim(spark, writes):
    """Edges that are all on cycles are not written again."""
    edges = fixpoint.settle(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long"))
    assert graph._trimmed(edges) is edges
    assert rows(graph._trimmed(fixpoint.settle(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (7, 8)], "src long, dst long")))) == [(1, 2), (2, 3), (3, 1)]


NAMES = {"addr": "l long, o long", "copy": "r long, l long", "gep": "r long, l long, w long", "store": "v long, proj long, r long", "load": "l long, v long, proj long", "ends": "i long, e long"}


def solved(spark, c, **more):
    return set(rows(pointsto.points_to(*(spark.createDataFrame(c[x], t) for x, t in NAMES.items()), **more)))


def plain(c):
    pts, copy, ends = {tuple(x) for x in c["addr"]}, {tuple(x) for x in c["copy"]}, dict(c["ends"])
    while True:
        size = len(pts) + len(copy)
        ok = lambda o, w: o in ends and o + w <= ends[o]
        copy |= {(r, o + p) for v, p, r in c["store"] for x, o in pts if x == v and ok(o, p)} | {(o + p, t) for t, v, p in c["load"] for x, o in pts if x == v and ok(o, p)}
        pts |= {(t, o) for r, t in copy for x, o in pts if x == r} | {(t, o + w) for r, t, w in c["gep"] for x, o in pts if x == r and ok(o, w)}
        if len(pts) + len(copy) == size:
            return pts


def test_points_to_with_cycles(spark):
    r, n = random.Random(3), 40
    slot = lambda: r.randrange(n)
    c = {
        "addr": [(slot(), slot()) for _ in range(12)], "copy": [(slot(), slot()) for _ in range(35)] + [(i, i + 1) for i in range(20, 30)] + [(30, 20)], "gep": [(slot(), slot(), 1) for _ in range(5)],
        "store": [(slot(), r.randint(0, 1), slot()) for _ in range(6)], "load": [(slot(), slot(), r.randint(0, 1)) for _ in range(6)], "ends": [(i, min(i + 1, n - 1) if i % 2 == 0 else i) for i in range(n)],
    }
    assert solved(spark, c) == plain(c)


def test_cycle_through_memory(spark):
    """x and y copy each other through what p points to: *p = x; y = *p; x = y."""
    c = {"addr": [(1, 9), (2, 8)], "copy": [(3, 2)], "gep": [], "store": [(1, 0, 2)], "load": [(3, 1, 0)], "ends": [(i, i) for i in range(12)]}
    assert solved(spark, c) == plain(c) == {(1, 9), (2, 8), (3, 8), (9, 8)}


def test_cycle_of_many_slots(spark, writes):
    """A cycle of 10,000 copies, with a way in and a way out: rounds and rows that move do not grow with it."""
    n = 10_000
    ids = list(range(100, 100 + n))
    random.Random(2).shuffle(ids)
    copy = spark.createDataFrame(list(zip(ids, [*ids[1:], ids[0]])) + [(1, ids[7]), (ids[5000], 2)], "r long, l long")
    make = lambda x, rows_: spark.createDataFrame(rows_, NAMES[x])
    out = pointsto.points_to(make("addr", [(1, 50)]), copy, make("gep", []), make("store", []), make("load", []), make("ends", [(50, 50)]))
    assert out.count() == n + 2 and out.select("loc").distinct().count() == n + 2
    assert writes[0] < 150


def test_facts_of_a_component_are_dealt_to_tasks(spark, monkeypatch):
    """A component of 120 with 90 facts and what hangs on it: each pair is made once, by many tasks, and no row of the result is shuffled."""
    monkeypatch.setattr(graph, "CELL", 20)
    n, m = 120, 90
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).union(spark.createDataFrame([(3, 1000), (2000, 3), (3000, 3001)], "src long, dst long"))
    facts = spark.range(m).select((F.col("id") % n).alias("v"), (F.col("id") + 500).alias("fact")).union(spark.createDataFrame([(1000, 7), (1000, 500), (4000, 8)], "v long, fact long"))
    found = graph.reaching(edges, facts)
    made = found.withColumn("task", F.spark_partition_id())
    assert made.count() == made.select("v", "fact").distinct().count() == (n + 1) * (m + 1) + 2 + 1
    assert {r["v"] for r in found.filter("fact = 7").collect()} == {*range(n), 1000, 2000} and rows(found.filter("v >= 3000")) == [(4000, 8)]
    by_task = [c for _, c in rows(made.groupBy("task").count())]
    assert len(by_task) > 10 and max(by_task) < n * m // 3
