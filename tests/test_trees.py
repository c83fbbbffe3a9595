"""Uses of expressions in deep trees, and names that are dead at a block's start."""

import random

from factloom.operators import graph, trees

KINDS = ["assign", "assign_op", "addr_of", "method_as_mut_ptr", "binding_by_ref", "block", "field", "field", "drop_temps", "drop_temps", "field"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_contexts(spark):
    r = random.Random(12)
    exprs = [(i, r.randrange(max(0, i - 3), i) if i and r.random() < 0.98 else None, r.choice(KINDS), r.randrange(2)) for i in range(400)]
    exprs += [(1000 + i, 999 + i if i else None, "field" if i else "assign", 0) for i in range(300)]  # a chain through which all goes
    exprs += [(2000 + i, 1999 + i if i else None, "drop_temps", 1) for i in range(40)]  # and one that ends in nothing
    by = {e[0]: e for e in exprs}

    def use(e):
        via, parent = e, by[e][1]
        while parent is not None and by[parent][2] in trees.PASSING_ON:
            via, parent = parent, by[parent][1]
        kind, first = (by[parent][2] if parent is not None else None), by[via][3] == 0
        if kind in ("assign", "assign_op") and first:
            return "store" if kind == "assign" else "compound_store"
        return "address" if kind in ("addr_of", "binding_by_ref") or (kind == "method_as_mut_ptr" and first) else "value"

    out = rows(trees.contexts(spark.createDataFrame(exprs, "expr long, parent long, kind string, slot int")))
    assert out == sorted((e, use(e)) for e in by) and {c for _, c in out} == {"value", "address", "store", "compound_store"}
    assert dict(out)[1299] == "store" and dict(out)[2039] == "value"


def test_dead_names(spark):
    """0 sets a, 1 reads a and sets b, 2 reads b; r is returned."""
    make = spark.createDataFrame
    edges = make([(0, 1), (1, 2), (2, 1)], "src long, dst long")
    live = graph.live_in(edges, make([(1, "a"), (2, "b")], "block long, name string"), make([(0, "a"), (1, "b")], "block long, name string"))
    assert rows(live) == [(1, "a"), (2, "a"), (2, "b")]
    blocks, names = make([(7, 0), (7, 1), (7, 2)], "fn long, block long"), make([(7, "a"), (7, "b"), (7, "r")], "fn long, name string")
    assert rows(graph.dead_names(blocks, names, live, make([(7, "r")], "fn long, name string"))) == [(0, "a"), (0, "b"), (1, "b")]
