"""Layout and constraints from statements, against golden cases and small programs worked out by hand."""

import pytest

from factloom.operators import constraints as cs
from factloom.operators import facts, graph, layout, pointsto
from factloom.plans import programs, registry
from factloom.sources import tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


STMT = "id long, root long, proj long, deref boolean, rvalue string, op string, len long, elem_len long"
OPERAND = "id long, pos int, kind string, root long, proj long, deref boolean, offset long, len long"


def solved(spark, stmts, operands):
    out = cs.constraints(cs.assignments(spark.createDataFrame(stmts, STMT), spark.createDataFrame(operands, OPERAND)))
    assert out["invalid"].count() == 0
    return {k: rows(v) for k, v in out.items() if k != "invalid"}


def test_statements(spark):
    stmts = [
        (1, 3, 0, False, "ref", None, 1, None), (2, 2, 0, False, "use", None, 1, None),  # _3 = &_1; _2 = _3
        (3, 5, 1, True, "use", None, 1, None), (4, 10, 0, False, "use", None, 2, None),  # (*_5).1 = _11; _10 = *_7, of two slots
        (5, 15, 0, False, "ref", None, 1, None), (6, 16, 0, False, "ref", None, 1, None),  # _15 = &(*_24).2; _16 = &*_24
        (7, 17, 0, False, "address_of", None, 1, None), (8, 18, 0, False, "binary", "Eq", 1, None),
        (9, 19, 0, False, "binary", "Add", 1, None), (10, 20, 0, False, "unary", "Not", 1, None), (11, 21, 0, False, "unary", "Neg", 1, None),
        (12, 30, 0, False, "aggregate_adt", None, 3, None), (13, 40, 0, False, "aggregate_array", None, 9, 1), (14, 41, 0, False, "cast", None, 1, None),
        (15, 42, 0, False, "len", None, 1, None), (16, 43, 0, False, "repeat", None, 4, 1), (17, 44, 0, False, "checked_binary", "Add", 2, 1), (18, 46, 0, False, "thread_local_ref", None, 1, None),
    ]
    place = lambda i, root, pos=0, proj=0, deref=False, offset=0, n=1, kind="place": (i, pos, kind, root, proj, deref, offset, n)
    operands = [
        place(1, 1), place(2, 3), place(3, 11), place(4, 7, deref=True), place(5, 24, proj=2, deref=True), place(6, 24, deref=True), place(7, 25, proj=1, deref=True),
        place(8, 1), place(8, 2, pos=1), place(9, 8, deref=True), place(9, 9, pos=1, deref=True), place(10, 1), place(11, 12),
        place(12, 50, n=2), place(12, 60, pos=1, offset=2, kind="fn"), place(13, 51), place(13, 52, pos=1), place(14, None, kind="int"), place(14, 70, kind="static"),
        place(15, 1), place(16, 53), place(17, 54), place(17, 55, pos=1), place(18, 71, kind="static"),
    ]
    assert solved(spark, stmts, operands) == {
        "addr": [(3, 1), (32, 60), (41, 70), (46, 71)],
        "copy": [(3, 2), (12, 21), (24, 16), (26, 17), (50, 30), (51, 31), (51, 40), (52, 40), (53, 43), (54, 44), (55, 44)],
        "gep": [(24, 15, 2)],
        "store": [(5, 1, 11)],
        "load": [(10, 7, 0), (11, 7, 1), (19, 9, 0)],
    }


def test_calls(spark):
    """Slots of the golden cases of a direct call, of one through a pointer with a struct argument, and of an allocation."""
    calls = [
        (1, "direct", None, 0, 9, 1, True, None), (2, "indirect", None, 24, 21, 3, False, None), (3, "extern", "malloc", None, 6, 1, True, 29),
        (4, "std", "ptr::offset", None, 33, 1, True, None), (5, "std", "mem::swap", None, 34, 1, True, None), (6, "method", "set_x", None, 35, 1, True, None), (7, "extern", "getchar", None, 36, 1, False, 40),
    ]
    args = [(1, 0, "place", 7, 0, False, 1), (2, 0, "place", 13, 0, False, 2), (2, 1, "int", None, 0, False, 1), (2, 2, "place", 26, 0, False, 1), (4, 0, "place", 32, 0, False, 1), (5, 0, "place", 32, 0, False, 1), (6, 0, "place", 32, 0, False, 1)]
    calls = spark.createDataFrame(calls, "id long, kind string, name string, callee long, dst long, dst_len long, dst_is_ptr boolean, alloc long")
    out = cs.constraints(cs.call_assignments(calls, spark.createDataFrame(args, "id long, pos int, kind string, root long, proj long, deref boolean, len long")))
    found = {k: rows(v) for k, v in out.items()}
    assert found["copy"] == [(1, 9), (7, 0), (32, 33)] and found["addr"] == [(6, 29)] and found["gep"] == found["invalid"] == []
    assert found["store"] == [(24, 0, 13), (24, 1, 14), (24, 3, 26)] and found["load"] == [(21, 24, 4), (22, 24, 5), (23, 24, 6)]


@pytest.fixture(scope="module")
def types(spark):
    """1 scalar, 2 pair {1, 1}, 3 array of pairs, 4 {1, array, two bit fields}, 5 empty struct, 6 union {1, pair}."""
    shapes = spark.createDataFrame([(1, "primitive", None), (2, "struct", None), (3, "array", 2), (4, "struct", None), (5, "struct", None), (6, "struct", None)], "ty long, kind string, elem long")
    fields = spark.createDataFrame([(2, 0, 1), (2, 1, 1), (4, 0, 1), (4, 1, 3), (4, 2, None), (4, 3, None), (6, 0, 1), (6, 1, 2)], "ty long, field int, child long")
    return shapes, fields, layout.lengths(shapes, fields)


def test_layout(spark, types):
    shapes, fields, lens = types
    assert rows(lens) == [(1, 1), (2, 2), (3, 2), (4, 5), (5, 1), (6, 3)]
    places = layout.offsets(fields, lens)
    assert [r[3] for r in sorted(rows(places), key=lambda r: r[:2]) if r[0] == 4] == [0, 1, 3, 4] and [r[3] for r in rows(places) if r[0] == 6] == [0, 1]
    ends = layout.type_ends(shapes, places, lens)
    assert [r[1:] for r in rows(ends) if r[0] == 4] == [(0, 4), (1, 2), (2, 2), (3, 3), (4, 4)]
    # returned value, a pair, three scalars: the ends of the golden case are 0, 2, 2, 3, 4, 5
    fns = spark.createDataFrame([(7, 0, 0), (8, 1, 1)], "fn long, item long, n_args int")
    locals_ = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (7, 2, 1), (7, 3, 1), (7, 4, 1), (8, 0, 1), (8, 1, 2), (8, 2, 1)], "fn long, local int, ty long")
    slots = layout.slots(fns, locals_, lens)
    assert [(r["fn"], r["local"], r["root"]) for r in sorted(slots.collect(), key=lambda r: r["root"])] == [(7, 0, 0), (7, 1, 1), (7, 2, 3), (7, 3, 4), (7, 4, 5), (8, 1, 6), (8, 0, 8), (8, 2, 9)]
    none = fns.select("fn").limit(0)
    assert [e for _, e in rows(layout.slot_ends(slots, ends, none))] == [0, 2, 2, 3, 4, 5, 7, 7, 8, 9]
    assert [e for _, e in rows(layout.slot_ends(slots, ends, fns.filter("fn = 8").select("fn")))] == [0, 2, 2, 3, 4, 5, 8, 7, 8, 9]
    sites = spark.createDataFrame([(0, 7, 3), (1, 8, 0), (1, 8, 5)], "item long, fn long, block int")
    roots, own = layout.allocation_slots(sites, slots, ends, spark.createDataFrame([(2,), (1,), (6,)], "ty long"))
    assert rows(roots) == [(7, 3, 10), (8, 0, 13), (8, 5, 16)] and [e for _, e in rows(own)] == [12, 12, 12, 15, 15, 15, 18, 18, 18]


def test_places(spark, types):
    shapes, fields, lens = types
    slots = spark.createDataFrame([(1, 1, 10, 4, None), (1, 2, 20, 1, 4)], "fn long, local int, root long, ty long, pointee long")
    f, i, d = (lambda n: {"kind": "field", "field": n}), {"kind": "index", "field": None}, {"kind": "deref", "field": None}
    places = [(1, 1, 1, []), (2, 1, 1, [f(1), i, f(1)]), (3, 1, 2, [d, f(3)]), (4, 1, 2, [d])]
    places = spark.createDataFrame(places, "id long, fn long, local int, path array<struct<kind:string,field:int>>")
    out = cs.place_slots(places, slots, layout.offsets(fields, lens), shapes)
    assert rows(out.select("id", "root", "proj", "deref")) == [(1, 10, 0, False), (2, 10, 2, False), (3, 20, 4, True), (4, 20, 0, True)]


def test_bitfields(spark):
    fields = spark.createDataFrame([(1, 0, "n", False), (1, 1, "c2rust_padding0", True), (1, 2, "a_b", True), (2, 0, "c_d", True)], "ty long, field int, name string, is_bytes boolean")
    accessors = [(1, 0, "set_a", None), (1, 1, "a", "int"), (1, 2, "set_b", None), (1, 3, "b", "bool"), (2, 0, "set_c", None), (2, 1, "x", "int")]
    out = layout.bitfields(fields, spark.createDataFrame(accessors, "ty long, pos int, name string, returns string"))
    assert rows(out) == [(1, "a", 3, "int"), (1, "b", 4, "bool")]


def test_call_graph_and_writes(spark):
    make = spark.createDataFrame
    pts = make([(5, 100), (5, 200), (5, 1), (6, 200)], "loc long, obj long")
    sites = make([(1, 5, 5), (2, 0, 6)], "fn long, block int, slot long")
    found = pointsto.resolve_indirect(sites, pts, make([(3, 100), (4, 200)], "callee long, obj long"))
    assert rows(found) == [(1, 5, 3), (1, 5, 4), (2, 0, 4)]
    calls = pointsto.call_graph(make([(4, 2)], "src long, dst long"), found)
    own = make([(3, 30), (4, 40), (2, 20), (9, 90)], "fn long, slot long")
    assert rows(pointsto.call_writes(own, calls)) == [(1, 20), (1, 30), (1, 40), (2, 20), (2, 40), (3, 30), (4, 20), (4, 40), (9, 90)]
    # an allocated object whose second slot starts a longer object than its first
    ends = make([(10, 11), (11, 14), (12, 12), (13, 13), (14, 14), (20, 20)], "i long, e long")
    assert rows(pointsto.address_taken(make([(1, 10), (2, 20)], "loc long, obj long"), ends)) == [(10,), (11,), (12,), (13,), (14,), (20,)]
    assert rows(pointsto.bitfield_writes(make([(1, 8, 5, "7.set_a")], "fn long, block int, loc long, method string"), make([(5, 8)], "loc long, obj long"), make([("7.set_a", 3)], "method string, offset long"))) == [(1, 8, 11)]
    assert rows(pointsto.dereferences(make([(1, 10), (2, 20)], "loc long, obj long"), make([(10, 2)], "obj long, most int"))) == [(1, 0, 10), (1, 1, 10), (1, 2, 10), (2, 0, 20)]


def test_allocators_from_flows(spark):
    """f1 returns malloc through a copy, f2 what f1 gave, f3's local is set through its address, f4 returns another local."""
    make = spark.createDataFrame
    copies = make([(1, 0, 3), (3, 0, 5), (4, 0, 1)], "fn long, dst int, src int")
    results = make([(1, 3, -1), (2, 0, 1), (3, 5, -1), (4, 2, -1)], "fn long, dst int, callee long")
    returned = facts.returned_calls(copies, make([(3, 5)], "fn long, local int"), results)
    assert rows(returned) == [(1, -1), (2, 1)]
    direct, calls = returned.filter("callee = -1").select("fn"), returned.filter("callee > 0").toDF("src", "dst")
    assert rows(facts.allocators(make([(1,), (2,), (3,), (4,)], "fn long"), direct, calls)) == [(1,), (2,)]


def test_loops_and_liveness(spark):
    make = spark.createDataFrame
    edges = make([(0, 1), (1, 2), (2, 3), (3, 2), (3, 4), (4, 1), (1, 5)], "src long, dst long")
    assert rows(graph.loop_bodies(edges, make([(0,)], "v long"))) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 3)]
    live = graph.live_out(edges, make([(2, "x"), (5, "y")], "block long, name string"), make([(0, "x"), (1, "y"), (4, "x")], "block long, name string"))
    assert rows(live) == [(0, "x"), (1, "x"), (1, "y"), (2, "x"), (3, "x"), (4, "x")]
    with pytest.raises(ValueError):
        graph.dominators(edges, make([(0,), (1,)], "v long"))


def test_loops_read_their_edges_once(spark, monkeypatch):
    """The operator, and the query that finds the entry among the edges as well, compute the edges a single time."""
    seen, made = spark.sparkContext.accumulator(0), [(0, 1), (1, 2), (2, 3), (3, 2), (3, 4), (4, 1), (1, 5)]

    def counted(row):
        seen.add(1)
        return row

    edges = spark.createDataFrame(spark.sparkContext.parallelize(made, 2).map(counted), "src long, dst long")
    expected = [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 3)]
    assert rows(graph.loop_bodies(edges, spark.createDataFrame([(0,)], "v long"))) == expected and seen.value == len(made)
    monkeypatch.setattr(programs, "sql", lambda *_: edges)
    assert rows(registry.QUERIES["loop_bodies"](spark, "")) == expected and seen.value == 2 * len(made)


def test_long_chain_and_components(spark):
    make = spark.createDataFrame
    chain = make([(i, i + 1) for i in range(12)] + [(20, 21), (21, 22), (22, 20), (22, 23), (23, 24), (24, 23), (3, 20)], "src long, dst long")
    assert [c for _, c in rows(graph.scc(chain))] == [*range(13), 20, 20, 20, 23, 23]
    assert len(rows(graph.transitive_closure(chain))) == 12 * 13 // 2 + 4 * 5 + 3 * 3 + 3 * 2 + 2 * 2
    assert rows(graph.merge_weighted(make([(21, 23, 1), (20, 24, 1), (1, 2, 4)], "src long, dst long, weight int"), graph.scc(chain))) == [(1, 2, 4), (20, 23, 1)]


def test_tags_and_text(spark):
    make = spark.createDataFrame
    access = make([(1, 1, 5, 9, [2, 1]), (1, 2, 15, 18, [3]), (1, 3, 25, 26, []), (1, 4, 5, 6, [1])], "key long, id long, lo long, hi long, tags array<int>")
    arms = make([(1, 1, 0, 10, 0, [1, 2]), (1, 2, 0, 20, 1, [3]), (1, 3, 20, 30, 2, None)], "key long, id long, lo long, hi long, ord int, tags array<int>")
    assert rows(facts.arm_accesses(access, arms)) == [(1, 1, 1), (1, 2, 2)]
    tags = "owner long, field long, variant string, tag long"
    claimed = make([(1, 1, "a", 0), (2, 1, "a", 0)], tags)
    assert rows(facts.extend_tags(claimed, make([(1, 1, "b", 1), (1, 1, "b", 0), (2, 1, "a", 7), (2, 1, "b", 7)], tags))) == [(1, 1, "a", 0), (1, 1, "b", 1)]
    seen, variants = make([(1, 0), (1, 5), (2, 9)], "owner long, tag long"), make([(1, "a"), (1, "b"), (2, "x"), (2, "y")], "owner long, variant string")
    assert sorted(map(str, rows(facts.remaining_tags(seen, make([(1, "a", 0)], "owner long, variant string, tag long"), variants)))) == ["(1, 5, 'b')", "(2, 9, None)"]
    assert rows(facts.variant_tags(make([(1, 1, "a", -1), (1, 1, "a", 4294967296), (1, 1, "a", 7)], tags))) == [(1, 1, "a", 7)]
    files = make([("a", "é0123")], "path string, content string")
    assert rows(facts.apply_edits(files, make([("a", 2, 3, "X")], "path string, lo int, hi int, text string"))) == [("a", "éX123")]
    assert rows(facts.snippets(files, make([("a", 0, 3)], "path string, lo long, hi long")).select("text")) == [("é0",)]
    kinds, calls = facts.split_calls(make([(1, "call", 2, None), (1, "call", 9, None), (2, "union", None, 4), (2, "union", None, 5)], "fn long, kind string, callee long, union_id long"), make([(1,), (2,)], "fn long"), [4])
    assert rows(kinds) == [(1, "call"), (2, "access"), (2, "union")] and rows(calls) == [(1, 2)]


def test_arithmetic(spark):
    from pyspark.sql import functions as F

    values = [-128, -127, -7, -1, 0, 1, 2, 5, 100, 127]
    df = spark.createDataFrame([(x, y) for x in values for y in values], "x long, y long")
    wrap = lambda v: (v + 128) % 256 - 128
    exact = {
        "Add": lambda x, y: wrap(x + y), "Sub": lambda x, y: wrap(x - y), "Mul": lambda x, y: wrap(x * y), "Div": lambda x, y: wrap(abs(x) // abs(y) * (1 if x * y >= 0 else -1)) if y else None,
        "Rem": lambda x, y: abs(x) % abs(y) * (1 if x >= 0 else -1) if y else None, "BitXor": lambda x, y: x ^ y, "BitAnd": lambda x, y: x & y, "BitOr": lambda x, y: x | y,
        "Shl": lambda x, y: wrap(x << y % 8), "Shr": lambda x, y: x >> y % 8, "Lt": lambda x, y: int(x < y), "Ne": lambda x, y: int(x != y),
    }
    out = df.select("x", "y", *[facts.arithmetic(op, F.col("x"), F.col("y"), 8).alias(op) for op in exact]).collect()
    assert all(r[op] == f(r["x"], r["y"]) for r in out for op, f in exact.items())


def test_solution_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([(1, 5), (1, 3), (4, 2)], "loc long, obj long")
    tables.write_solution(pts, spark.range(6).toDF("loc"), str(tmp_path / "solution"))
    assert rows(tables.read_solution(spark, str(tmp_path / "solution"))) == rows(pts)
    assert spark.read.parquet(str(tmp_path / "solution")).count() == 6
    spark.createDataFrame([(1, "f", "fn", False, False, 0, 1, "more"), (2, "main", "fn", False, True, 1, 0, "")], tables.SCHEMAS["fns"] + ", extra string").write.parquet(str(tmp_path / "fns.parquet"))
    assert rows(tables.bodies(tables.read(spark, str(tmp_path), "fns")).select("fn")) == [(1,)]
