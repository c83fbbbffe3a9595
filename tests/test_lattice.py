"""Integer sets on control-flow graphs: golden programs, and random ones against a plain work list."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import fixpoint, lattice

STMTS = "fn long, block long, stmt long, dst long, op string, x long, x_const long, y long, y_const long"
REFINED = "fn long, src long, dst long, local long, keep long, drop array<long>"


def const(dst, n):
    return (dst, "const", None, n, None, None)


def copy(dst, x):
    return (dst, "copy", x, None, None, None)


def states(spark, programs, heads=None):
    """programs: fn -> (blocks, edges, refined, number of locals); (fn, block, stmt, local) -> tuple, or None for any."""
    stmts = [(f, b, s, *x) for f, p in programs.items() for b, xs in p[0].items() for s, x in enumerate(xs)]
    edges = [(f, a, b) for f, p in programs.items() for a, b in p[1]]
    refined = [(f, *r) for f, p in programs.items() for r in p[2]]
    locals_ = [(f, x) for f, p in programs.items() for x in range(1, p[3] + 1)]
    make = spark.createDataFrame
    out = lattice.int_states(
        make(stmts, STMTS), make(edges, "fn long, src long, dst long"), make(locals_, "fn long, local long"), make([(f, 0) for f in programs], "fn long, block long"), make(refined, REFINED),
        None if heads is None else make(heads, "fn long, block long"),
    )
    return {tuple(r[:4]): None if r["value"] is None else tuple(r["value"]) for r in out.collect()}


GOLDEN = {
    # y = z = 0; if x != 0 {y = z = 1}
    1: ({0: [const(2, 0), const(3, 0)], 1: [const(4, 1), copy(2, 4), const(5, 1), copy(3, 5)], 2: []}, [(0, 1), (0, 2), (1, 2)], [(0, 2, 1, 0, None), (0, 1, 1, None, [0])], 5),
    # match x {1: y = x, 2: z = x, _: w = x}
    2: ({0: [const(2, 1), const(3, 2), const(4, 3)], 1: [copy(4, 1)], 2: [copy(2, 1)], 3: [copy(3, 1)], 4: []}, [(0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (3, 4)],
        [(0, 2, 1, 1, None), (0, 3, 1, 2, None), (0, 1, 1, None, [1, 2])], 4),
    # y = 0; if x == 0 {y = x}
    3: ({0: [const(2, 0), const(4, 0), (3, "Eq", 1, None, 4, None)], 1: [copy(2, 1)], 2: []}, [(0, 1), (0, 2), (1, 2)], [(0, 1, 1, 0, None), (0, 2, 1, None, [0])], 4),
    # y = 1; if x != 0 {y = 0} else {y = x}
    4: ({0: [const(2, 1), const(4, 0), (3, "Ne", 1, None, 4, None)], 1: [const(5, 0), copy(2, 5)], 2: [copy(2, 1)], 3: []}, [(0, 1), (0, 2), (1, 3), (2, 3)],
        [(0, 2, 1, 0, None), (0, 1, 1, None, [0])], 5),
    # while x < 10 {x += 1; y = x}
    5: ({0: [const(1, 0), const(2, 0)], 1: [copy(4, 1), const(5, 10), (3, "Lt", 4, None, 5, None)], 2: [], 3: [const(6, 1), (1, "Add", 1, None, 6, None), copy(7, 1), copy(2, 7)]},
        [(0, 1), (1, 2), (1, 3), (3, 1)], [], 7),
    # match x {1: y = 1, 2: y = 2, _: y = 3}; match y {1 | 2: z = 3, _: z = y}
    6: ({0: [const(2, 0)], 1: [const(5, 3), copy(2, 5)], 2: [const(3, 1), copy(2, 3)], 3: [const(4, 2), copy(2, 4)], 4: [const(6, 0)], 5: [copy(8, 2), copy(6, 8)], 6: [const(7, 3), copy(6, 7)], 7: []},
        [(0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7)], [(0, 2, 1, 1, None), (0, 3, 1, 2, None), (4, 5, 2, None, [1, 2])], 8),
    # a block that nothing reaches sets nothing
    7: ({0: [const(1, 4)], 1: [const(1, 5)], 2: []}, [(0, 2), (1, 2)], [], 1),
}


@pytest.fixture(scope="module")
def golden(spark):
    return states(spark, GOLDEN)


def test_golden_programs(golden):
    at = lambda fn, block, local: golden[(fn, block, lattice.START, local)]
    assert at(1, 2, 2) == at(1, 2, 3) == (0, 1)  # no single value
    assert (at(2, 4, 2), at(2, 4, 3), at(2, 4, 4)) == ((1,), (2,), None)
    assert at(3, 2, 2) == (0,) and at(4, 3, 2) == (0,)
    assert at(5, 2, 1) is None and at(5, 2, 2) is None  # widened
    assert at(6, 7, 6) == (3,) and at(6, 4, 2) == (1, 2, 3)
    assert at(7, 2, 1) == (4,) and not [k for k in golden if k[:2] == (7, 1)]


def test_operations_inside_a_block(golden):
    assert golden[(3, 0, 2, 3)] is None  # x is not known
    assert golden[(1, 1, 1, 2)] == (1,)


def test_loop_heads(spark):
    edges = [(f, a, b) for f, p in GOLDEN.items() for a, b in p[1]] + [(9, 0, 0), (9, 0, 1), (9, 1, 2), (9, 2, 1)]
    entries = [(f, 0) for f in [*GOLDEN, 9]]
    out = lattice.loop_heads(spark.createDataFrame(edges, "fn long, src long, dst long"), spark.createDataFrame(entries, "fn long, block long"))
    assert {tuple(r) for r in out.collect()} == {(5, 1), (9, 0), (9, 1)}


def plain(program):
    """The same by passing whole states along edges until nothing changes (joins only)."""
    blocks, edges, refined, n = program
    start = {0: {x: None for x in range(1, n + 1)}}
    union = lambda a, b: None if a is None or b is None or len(set(a) | set(b)) > lattice.MOST else tuple(sorted(set(a) | set(b)))
    rules = {(a, b, x): (k, d) for a, b, x, k, d in refined}
    todo = [0]
    while todo:
        a = todo.pop()
        state = dict(start[a])
        for dst, op, x, x_const, y, y_const in blocks[a]:
            value = lambda o, c: (c,) if o is None else state[o]
            if op == "const":
                state[dst] = (x_const,)
            elif op == "copy":
                state[dst] = state[x]
            elif op == "any":
                state[dst] = None
            else:
                p, q = value(x, x_const), value(y, y_const)
                state[dst] = ({"Add": p[0] + q[0], "Mul": p[0] * q[0]}[op],) if p and q and len(p) == len(q) == 1 else None
        for b in (y for x, y in edges if x == a):
            moved = {}
            for x, v in state.items():
                keep, drop = rules.get((a, b, x), (None, None))
                moved[x] = (keep,) if keep is not None else v if v is None or drop is None else tuple(i for i in v if i not in drop)
            joined = moved if b not in start else {x: union(start[b][x], moved[x]) for x in moved}
            if joined != start.get(b):
                start[b] = joined
                todo.append(b)
    return {(b, x): v for b, s in start.items() for x, v in s.items()}


def test_random_programs(spark):
    r, programs = random.Random(11), {}
    for fn in range(12):
        n, size = r.randint(2, 5), r.randint(3, 7)
        local = lambda: r.randint(1, n)

        def stmt():
            kind = r.choice(["const", "const", "copy", "any", "Add", "Mul"])
            if kind in ("const", "any"):
                return (local(), kind, None, r.randint(0, 30) if kind == "const" else None, None, None)
            if kind == "copy":
                return copy(local(), local())
            return (local(), kind, *r.choice([(local(), None, local(), None), (local(), None, None, 3), (None, 2, None, 5)]))

        blocks = {b: [stmt() for _ in range(r.randint(0, 4))] for b in range(size)}
        edges = sorted({(a, b) for a in range(size) for b in range(size) if a != b and (b == a + 1 or r.random() < 0.2)} if fn else {(a, b) for a in range(size) for b in range(a + 1, size)})
        refined = [(a, b, x, None, [1, 2, 3, r.randint(0, 30)]) if r.random() < 0.5 else (a, b, x, r.randint(0, 9), None) for a, b in edges for x in [local()] if r.random() < 0.4]
        programs[fn] = (blocks, edges, refined, n)
    # constants are bounded, so joins alone end: sums and products of single values stop at any
    out = states(spark, programs, heads=[])
    for fn, p in programs.items():
        assert {(b, x): v for (f, b, s, x), v in out.items() if f == fn and s == lattice.START} == plain(p), fn


def test_bounded_sets(spark):
    rows = spark.range(100_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.col("id") % 10).alias("v"))
    assert {r["k"]: r["v"] for r in lattice.bounded_sets(rows, ["k"], "v").collect()} == {0: None, 1: list(range(10))}


def test_no_functions(spark):
    assert states(spark, {1: ({0: []}, [], [], 1)}) == {(1, 0, lattice.START, 1): None}


def test_done_functions_are_laid_aside(spark):
    """Functions that end in round 1 to 20: with `apart`, later rounds see only the rows of those that still change, and the result is the same."""
    hops = spark.createDataFrame([(fn, k, k + 1) for fn in range(40) for k in range(20 if fn == 7 else fn % 3 + 1)], "fn long, at long, to long")
    seed = spark.createDataFrame([(fn, 0, [fn]) for fn in range(40)], "fn long, at long, value array<long>")
    seen = []

    def step(changed, known, hops):
        seen.append(known.select("fn").distinct().count())
        return changed.join(hops, ["fn", "at"]).select("fn", F.col("to").alias("at"), "value")

    rows = lambda df: sorted((r["fn"], r["at"], tuple(r["value"])) for r in df.select("fn", "at", "value").collect())
    apart = rows(lattice.lattice_fixpoint(seed, step, facts=[hops], apart=["fn"]))
    assert seen[0] == 40 and seen[-1] == 1
    assert apart == sorted((fn, k, (fn,)) for fn in range(40) for k in range((20 if fn == 7 else fn % 3 + 1) + 1))


def test_rounds_shuffle_only_what_a_step_gives(spark, monkeypatch):
    """With `apart`, known rows and facts stay where they are: of a round's tables only the one that step() gives is dealt anew, once."""
    plans, real = [], lattice.dealt

    def spied(df, *columns):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *columns)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hops = real(spark.createDataFrame([(fn, k, k + 1, k % 2) for fn in range(9) for k in range(4)], "fn long, at long, to long, w long"), "fn")
        seed = spark.createDataFrame([(fn, 0, [fn]) for fn in range(9)], "fn long, at long, value array<long>")
        monkeypatch.setattr(lattice, "dealt", spied)
        step = lambda changed, known, hops: changed.join(hops, ["fn", "at"]).join(known.select("fn", "at"), ["fn", "at"]).select("fn", F.col("to").alias("at"), "value")
        out = lattice.lattice_fixpoint(seed, step, facts=[hops], apart=["fn"])
        assert sorted((r["fn"], r["at"], *r["value"]) for r in out.collect()) == [(fn, k, fn) for fn in range(9) for k in range(5)]
        rounds = [plan.count("Exchange hashpartitioning") for plan in plans[1:]]
        assert len(rounds) >= 8 and max(rounds[::2]) <= 1 and set(rounds[1::2]) == {0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_packed_files_are_not_broadcast(spark, tmp_path):
    """2 million rows in files of 3 MB are too many for the driver to gather."""
    from factloom.plans import registry

    held = {name: spark.conf.get(name, None) for name in [*registry.TOGETHER, "spark.sql.sources.fileCompressionFactor"]}
    try:
        spark.range(10).selectExpr("id AS r_regionkey").write.parquet(f"{tmp_path}/region.parquet")
        registry.sql(spark, str(tmp_path), "SELECT r_regionkey FROM region")
        rows = fixpoint.settle(spark.range(2_000_000).selectExpr("abs(hash(id)) % 100 AS k", "abs(hash(id, 1)) % 7 AS v"))
        plan = spark.range(10_000_000).selectExpr("id % 50 AS k").join(rows, "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
