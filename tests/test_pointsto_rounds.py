"""points_to() on chains and cycles: rounds shuffle what is new, not the constraints."""

from factloom.operators import fixpoint, pointsto


def plain(addr, copy, gep, store, load, ends):
    pts, edges = set(addr), set(copy)
    while True:
        more = {(l, o) for r, l in edges for x, o in pts if x == r} | {(l, o + w) for r, l, w in gep for x, o in pts if x == r and o + w <= ends.get(o, -1)}
        made = {(r, o + p) for v, p, r in store for x, o in pts if x == v and o + p <= ends.get(o, -1)} | {(o + p, l) for l, v, p in load for x, o in pts if x == v and o + p <= ends.get(o, -1)}
        if more <= pts and made <= edges:
            return pts
        pts, edges = pts | more, edges | made


def test_constraints_are_not_shuffled_in_rounds(spark):
    addr, ends = [(1, 100), (2, 200), (9, 7)], {100: 103, 101: 101, 102: 103, 103: 103, 200: 200}
    copy, gep = [(1, 3), (3, 4), (4, 1), (2, 5)], [(3, 6, 2), (6, 8, 1), (2, 8, 1)]
    store, load = [(4, 1, 2), (6, 0, 5), (9, 0, 2)], [(10, 1, 1), (11, 6, 0)]
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names.split()))
    found = pointsto.points_to(df(addr, "l o"), df(copy, "r l"), df(gep, "r l w"), df(store, "v proj r"), df(load, "l v proj"), df(list(ends.items()), "i e"))
    assert {(r["loc"], r["obj"]) for r in found.collect()} == plain(addr, copy, gep, store, load, ends)


def test_dealt_rows_join_without_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).selectExpr("id % 7 as k", "id as a")
        kept = fixpoint.dealt(rows, "k")
        joined = spark.range(7).withColumnRenamed("id", "k").join(kept, "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert joined.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rounds_deal_only_what_they_derive(spark, monkeypatch):
    """Facts, edges and constraints stay where they are: a round's edges are dealt once, its facts once and, for their ends, those with an offset."""
    plans, real = [], pointsto.dealt

    def spied(df, *columns):
        plans.append((columns, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return real(df, *columns)

    addr, ends = [(1, 100), (2, 200), (9, 7)], {100: 103, 101: 101, 102: 103, 103: 103, 200: 200}
    copy, gep = [(1, 3), (3, 4), (4, 11), (11, 12), (12, 13), (2, 5)], [(3, 6, 2), (6, 8, 1), (2, 8, 1)]
    store, load = [(4, 1, 2), (6, 0, 5), (9, 0, 2)], [(10, 1, 1), (11, 6, 0)]
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names.split()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(pointsto, "dealt", spied)
    try:
        found = pointsto.points_to(df(addr, "l o"), df(copy, "r l"), df(gep, "r l w"), df(store, "v proj r"), df(load, "l v proj"), df(list(ends.items()), "i e"), contract=False)
        assert {(r["loc"], r["obj"]) for r in found.collect()} == plain(addr, copy, gep, store, load, ends)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rounds = plans[6:]  # after ends, addr and the four kinds of constraints
    assert len(rounds) > 6
    assert all(n <= 1 for columns, n in rounds if columns == ("r",)) and all(n <= 2 for columns, n in rounds if columns == ("loc",))
