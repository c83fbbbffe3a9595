"""Golden points-to cases and small graph cases."""

import pytest

from factloom.operators import facts, graph, pointsto


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


CASES = {
    # name: n, ends, addr, copy (r, l), gep (r, l, w), store (v, proj, r), load (l, v, proj), expected
    "load": (7, {}, [(3, 1), (5, 2)], [(3, 2), (5, 4)], [], [], [(6, 4, 0)], {2: {1}, 3: {1}, 4: {2}, 5: {2}, 6: {1}}),
    "store_ends": (
        12, {}, [(7, 3), (9, 1), (11, 2)], [(7, 6), (6, 5), (9, 8), (11, 10)], [], [(5, 0, 8), (5, 1, 10)], [],
        {3: {1}, 5: {3}, 6: {3}, 7: {3}, 8: {1}, 9: {1}, 10: {2}, 11: {2}},
    ),
    "cycle": (
        12, {1: 2}, [(4, 1)], [(4, 3), (5, 6), (6, 3), (3, 7), (7, 5), (9, 8), (11, 10)], [(3, 9, 1), (5, 11, 1)], [], [],
        {3: {1}, 4: {1}, 5: {1}, 6: {1}, 7: {1}, 8: {2}, 9: {2}, 10: {2}, 11: {2}},
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_points_to(spark, name):
    n, ends, addr, copy, gep, store, load, expected = CASES[name]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = pointsto.points_to(
        make(addr, "l long, o long"), make(copy, "r long, l long"), make(gep, "r long, l long, w long"), make(store, "v long, proj long, r long"),
        make(load, "l long, v long, proj long"), make([(i, ends.get(i, i)) for i in range(n)], "i long, e long"),
    )
    found = {}
    for loc, obj in pairs(out):
        found.setdefault(loc, set()).add(obj)
    assert found == expected


def test_closure_and_components(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (6, 7)])
    closure = pairs(graph.transitive_closure(e))
    assert (1, 1) in closure and (4, 4) not in closure and (1, 4) in closure and len(closure) == 13
    assert pairs(graph.scc(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (6, 6), (7, 7)]
    assert pairs(graph.components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6)]


def test_empty_graph(spark):
    e = edges(spark, [])
    assert pairs(graph.transitive_closure(e)) == [] and pairs(graph.components(e)) == []


def test_dominators(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 2)])
    entry = spark.createDataFrame([(1,)], "v long")
    assert pairs(graph.dominators(e, entry)) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (3, 3), (4, 4)]
    assert pairs(graph.back_edges(edges(spark, [(1, 2), (2, 3), (3, 2)]), entry).select("src", "dst")) == [(3, 2)]


def test_edits_and_tags(spark):
    files = spark.createDataFrame([("a", "0123456789"), ("b", "same")], "path string, content string")
    edits = spark.createDataFrame([("a", 5, 7, "X"), ("a", 0, 2, "")], "path string, lo int, hi int, text string")
    assert pairs(facts.apply_edits(files, edits)) == [("a", "234X789"), ("b", "same")]
    uses = spark.createDataFrame([(1, 1, "x", 5), (1, 1, "y", 5), (1, 2, "x", 1), (1, 2, "y", 2)], "owner long, field long, variant string, tag long")
    assert pairs(facts.discover_tags(uses)) == [(1, 2, 2)]


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "transitive_closure" in e.queries()
