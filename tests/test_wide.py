"""Arithmetic of 8 to 128 bits against Python's integers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import wide

WORD = 1 << 64


def pack(v):
    v %= 1 << 128
    signed = lambda w: w - WORD if w >= WORD // 2 else w
    return signed(v // WORD), signed(v % WORD)


def unpack(r, signed=True):
    if r is None:
        return None
    v = (r["hi"] % WORD) * WORD + r["lo"] % WORD
    return v - (1 << 128) if signed and v >= 1 << 127 else v


def wrapped(v, bits, signed):
    v %= 1 << bits
    return v - (1 << bits) if signed and v >= 1 << (bits - 1) else v


def expected(op, x, y, bits, signed):
    toward_zero = lambda: (abs(x) // abs(y)) * (1 if (x < 0) == (y < 0) else -1)
    if op in ("Div", "Rem"):
        if y == 0:
            return None
        return wrapped(toward_zero() if op == "Div" else x - y * toward_zero(), bits, signed)
    if op in wide.COMPARISONS:
        return int({"Eq": x == y, "Ne": x != y, "Lt": x < y, "Le": x <= y, "Gt": x > y, "Ge": x >= y}[op])
    value = {"Add": lambda: x + y, "Sub": lambda: x - y, "Mul": lambda: x * y, "BitXor": lambda: x ^ y, "BitAnd": lambda: x & y, "BitOr": lambda: x | y, "Shl": lambda: x << y % bits, "Shr": lambda: x >> y % bits}[op]()
    return wrapped(value, bits, signed)


@pytest.mark.parametrize("bits", [8, 64, 128])
def test_all_operations(spark, bits):
    r = random.Random(bits)
    for signed in (True, False):
        low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
        edge = [v for v in (low, low + 1, high, high - 1, 0, 1, 2, -1, 7, 1 << (bits // 2)) if low <= v <= high]
        values = [(x, y) for x in edge for y in edge] + [(r.randint(low, high), r.randint(low, high) >> r.randrange(bits)) for _ in range(40)]
        df = spark.createDataFrame([(i, pack(x), pack(y)) for i, (x, y) in enumerate(values)] + [(-1, None, pack(1)), (-2, pack(1), None)], "i long, x struct<hi:long,lo:long>, y struct<hi:long,lo:long>").repartition(4)
        out = df.select("i", *[wide.wide_arithmetic(op, F.col("x"), F.col("y"), bits, signed).alias(op) for op in wide.BINARY], *[wide.wide_unary(op, F.col("x"), bits, signed).alias(op) for op in ("Not", "Neg")])
        for row in out.collect():
            if row["i"] < 0:
                assert all(row[op] is None for op in wide.BINARY)
                continue
            x, y = values[row["i"]]
            for op in wide.BINARY:
                assert unpack(row[op], signed) == expected(op, x, y, bits, signed), (op, x, y, signed)
            assert unpack(row["Not"], signed) == wrapped(~x, bits, signed) and unpack(row["Neg"], signed) == wrapped(-x, bits, signed)


def test_conversions(spark):
    values = [0, 1, -1, 127, 128, 255, 256, -129, 2**63, 2**64 - 1, 2**64, -(2**64), 2**127 - 1, -(2**127), 123456789012345678901234567890]
    df = spark.createDataFrame([(i, pack(v)) for i, v in enumerate(values)], "i long, x struct<hi:long,lo:long>")
    types = [(b, s) for b in (8, 16, 32, 64, 128) for s in (True, False)]
    out = df.select("i", *[wide.wrap_wide(F.col("x"), b, s).alias(f"t{b}{s}") for b, s in types]).collect()
    assert all(unpack(row[f"t{b}{s}"], s) == wrapped(values[row["i"]], b, s) for row in out for b, s in types)
    assert unpack(spark.range(1).select(wide.of_long(F.lit(-5)).alias("x")).first()["x"]) == -5


def test_a_quotient_takes_no_step_for_each_bit(spark):
    """200,000 rows: a step of column expressions for each bit took minutes."""
    rows = spark.range(200_000).select("id", wide.of_long(F.col("id") * 7919191919 - 10**14).alias("x"), wide.of_long(F.col("id") - 70001).alias("y"))
    began = time.time()
    out = rows.select("id", wide.wide_arithmetic("Div", F.col("x"), F.col("y"), 128)["lo"].alias("q"), wide.wide_arithmetic("Rem", F.col("x"), F.col("y"), 64)["lo"].alias("r"))
    wrong = out.filter("id <> 70001").filter("q * (id - 70001) + r <> id * 7919191919 - 100000000000000 or abs(r) >= abs(id - 70001)")
    assert wrong.count() == 0 and out.filter("q is null").count() == 1
    assert time.time() - began < 20


def test_half_a_value_is_none(spark):
    df = spark.createDataFrame([((None, 1), (0, 1)), ((0, 1), (0, None)), ((0, 3), (0, 2))], "x struct<hi:long,lo:long>, y struct<hi:long,lo:long>").coalesce(1)
    assert [unpack(r[0]) for r in df.select(wide.wide_arithmetic("Add", F.col("x"), F.col("y"), 32)).collect()] == [None, None, 5]
