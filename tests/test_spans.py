"""Overlapping spans of very different lengths, branches around accesses, tags told by branches, candidates and edits."""

import random

import pytest

from factloom.operators import facts

SPANS = "key long, id long, lo long, hi long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlaps_of_any_length(spark):
    r = random.Random(6)

    def spans(n):
        out = []
        for i in range(n):
            lo = r.choice([r.randrange(200), r.randrange(3_000_000), -r.randrange(50)])
            out.append((r.randrange(3), i, lo, lo + r.choice([0, 1, 1, 2, 3, 7, 64, 65, 1000, 1_000_000, 2**40])))
        return out

    left, right = spans(150), spans(150)
    expected = sorted((k, a, b) for k, a, lo, hi in left for m, b, x, y in right if k == m and lo < y and x < hi)
    assert rows(facts.overlaps(spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS))) == expected
    assert facts.overlaps(spark.createDataFrame(left, SPANS), spark.createDataFrame([], SPANS)).count() == 0


def test_long_spans_take_few_rows(spark):
    from pyspark.sql import functions as F

    spans = spark.createDataFrame([(1, 1, 5, 5 + 10**6), (1, 2, 7, 8), (1, 3, 2**30 - 1, 2**31 + 1)], "key long, x_id long, x_lo long, x_hi long").withColumn("own", facts._level("x_lo", "x_hi"))
    every = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda n: n >= F.col("own"))
    counts = facts._cells(spans, "x", every).groupBy("x_id", "level").count().agg(F.max("count")).first()[0]
    assert counts <= 2


def test_branches_around_accesses(spark):
    make = spark.createDataFrame
    accesses = make([(1, 10, 22, 23), (1, 11, 35, 36), (1, 12, 90, 91), (2, 13, 22, 23)], SPANS)
    ifs = make([(1, 1, 5, 8, 20, 30, 31, 40), (1, 2, 15, 18, 21, 25, None, None), (1, 3, 60, 61, 70, 71, None, None)], "key long, id long, cond_lo long, cond_hi long, true_lo long, true_hi long, false_lo long, false_hi long")
    switches = make([(1, 100, 6, 7, 1000, 1001, 1002), (1, 101, 7, 16, 1010, 1011, 1012), (1, 102, 50, 51, 1020, 1021, 1022)], SPANS + ", at long, on_true long, on_false long")
    assert rows(facts.if_accesses(accesses, ifs, switches)) == [
        (1, 10, 1, True, 100, 1000, 1001), (1, 10, 1, True, 101, 1010, 1011), (1, 10, 2, True, 101, 1010, 1011),
        (1, 11, 1, False, 100, 1000, 1002), (1, 11, 1, False, 101, 1010, 1012),
    ]


def test_tagged_by_branch(spark):
    make = spark.createDataFrame
    asked = make([(1, 7, 0, "t", 10, 20, 30), (2, 7, 0, "t", 11, 20, 31), (3, 8, 0, "t", 10, 21, 30), (4, 9, 0, "t", 10, 20, 32)], "access long, branch long, field long, tagset string, here long, entry long, before long")
    paths = make([(a, p) for a in (1, 2, 3, 4) for p in ("p", "q")], "access long, path string")
    tags = make([(10, "p", 0, "t"), (10, "q", 0, "t"), (11, "p", 0, "t"), (20, "p", 0, "t"), (20, "q", 0, "t"), (30, "q", 0, "t"), (30, "p", 0, "u"), (30, "p", 1, "t")], "place long, path string, field long, tagset string")
    known = make([(10,), (11,), (20,), (21,), (30,), (32,)], "place long")
    # 2: no state before its branch; 3: its own branch begins where nothing is known, though another access's branch would do; 4: a state in which nothing is known
    assert rows(facts.tagged_by_branch(asked, paths, tags, known)) == [(1, 7, 0, "t", "p"), (4, 9, 0, "t", "p"), (4, 9, 0, "t", "q")]


def test_candidates_by_type_name(spark):
    make = spark.createDataFrame
    fields = make(
        [(1, 0, "int", 100, "c_int"), (1, 1, "union", 200, "C2RustUnnamed_3"), (2, 0, "union", 201, "Named"), (2, 1, "int", 100, "C2RustUnnamed_tag"), (3, 0, "int", 100, "c_int"), (3, 1, "union", 202, "C2RustUnnamed"),
         (4, 0, "union", 203, "C2RustUnnamed_9"), (5, 0, "bool", 101, "bool"), (5, 1, "union", 204, "C2RustUnnamed_1")], "ty long, field long, kind string, type long, type_name string")
    structs = make([(i,) for i in range(1, 6)], "ty long")
    args = structs, fields, make([(5,)], "ty long"), make([(3, 0)], "ty long, field long")
    assert rows(facts.candidates(*args)) == [(1, 1, 200)]
    bits = make([(4, 1)], "ty long, field long")
    assert rows(facts.candidates(*args, bits)) == [(1, 1, 200), (4, 0, 203)]
    assert rows(facts.candidates(*args, bits, make([(203,)], "union long"))) == [(4, 0, 203)]


def test_edits(spark):
    make = spark.createDataFrame
    files = make([("a", "0123456789"), ("b", "äöü"), ("c", "same"), ("d", "")], "path string, content string")
    edits = make([("a", 5, 7, "X"), ("a", 0, 2, ""), ("a", 10, 10, "!"), ("a", 5, 5, "<"), ("b", 2, 4, "oe"), ("d", 0, 0, "new"), ("gone", 0, 1, "x")], "path string, lo int, hi int, text string")
    assert rows(facts.apply_edits(files, edits)) == [("a", "234<X789!"), ("b", "äoeü"), ("c", "same"), ("d", "new")]
    many = make([("a", i, i + 1, "xy") for i in range(10)], "path string, lo int, hi int, text string")
    assert rows(facts.apply_edits(files.filter("path = 'a'"), many)) == [("a", "xy" * 10)]
    clash = make([("a", 2, 6, "XY"), ("a", 4, 8, "Z"), ("b", 0, 2, "")], "path string, lo int, hi int, text string")
    assert rows(facts.edit_conflicts(clash)) == [("a", 2, 6, 4)]
    with pytest.raises(Exception, match="overlapping edits of a"):
        facts.apply_edits(files, clash).collect()
