"""Integers of up to 128 bits in two's complement, as struct(hi, lo) of two longs; no decimal type holds them all.

A value of a narrower type is kept extended to 128 bits, by its sign or, if unsigned, by zeros. All functions give column expressions; the operations
themselves run on whole Arrow batches, a value being two numpy arrays of unsigned words, so that a row costs some vector steps and no step for each bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = ("Eq", "Ne", "Lt", "Le", "Gt", "Ge")
BINARY = ("Add", "Sub", "Mul", "Div", "Rem", "BitXor", "BitAnd", "BitOr", "Shl", "Shr", *COMPARISONS)
WORD, HALF = 64, np.uint64(0xFFFFFFFF)
_u = np.uint64
_ONES = _u(2**64 - 1)
Words = tuple[np.ndarray, np.ndarray]


def _add(a: Words, b: Words) -> Words:
    lo = a[1] + b[1]
    return a[0] + b[0] + (lo < a[1]).astype(_u), lo


def _sub(a: Words, b: Words) -> Words:
    return a[0] - b[0] - (a[1] < b[1]).astype(_u), a[1] - b[1]


def _not(a: Words) -> Words:
    return ~a[0], ~a[1]


def _neg(a: Words) -> Words:
    return _sub((np.zeros_like(a[0]), np.zeros_like(a[1])), a)


def _mul(a: Words, b: Words) -> Words:
    half = _u(WORD // 2)
    (x1, x0), (y1, y0) = (a[1] >> half, a[1] & HALF), (b[1] >> half, b[1] & HALF)
    low, one, other = x0 * y0, x0 * y1, x1 * y0
    middle = (low >> half) + (one & HALF) + (other & HALF)
    over = x1 * y1 + (one >> half) + (other >> half) + (middle >> half)
    return over + a[0] * b[1] + a[1] * b[0], (low & HALF) | (middle << half)


def _choose(where: np.ndarray, a: Words, b: Words) -> Words:
    return np.where(where, a[0], b[0]), np.where(where, a[1], b[1])


def _negative(a: Words) -> np.ndarray:
    return a[0] >> _u(WORD - 1) != 0


def _divided(a: Words, b: Words) -> tuple[Words, Words]:
    """Quotient and remainder of numbers without sign; those that no word holds are divided as Python's integers."""
    q, r = np.divmod(a[1], np.maximum(b[1], _u(1)))
    (q1, q0), (r1, r0) = (np.zeros_like(q), q), (np.zeros_like(r), r)
    large = np.flatnonzero((a[0] | b[0]) != 0)
    if len(large):
        whole = lambda x: (x[0][large].astype(object) << WORD) | x[1][large].astype(object)
        n, d = whole(a), whole(b)
        d[d == 0] = 1  # such a row is null in the end
        for out, value in (((q1, q0), n // d), ((r1, r0), n % d)):
            out[0][large], out[1][large] = (value >> WORD).astype(_u), (value & (2**WORD - 1)).astype(_u)
    return (q1, q0), (r1, r0)


def _quotient(op: str, a: Words, b: Words, signed: bool) -> Words:
    if not signed:
        return _divided(a, b)[op == "Rem"]
    out = _divided(_choose(_negative(a), _neg(a), a), _choose(_negative(b), _neg(b), b))[op == "Rem"]
    minus = _negative(a) != _negative(b) if op == "Div" else _negative(a)
    return _choose(minus, _neg(out), out)


def _moved(a: Words, by: np.ndarray, left: bool, signed: bool) -> Words:
    """All bits moved by 0 to 127 places; from above comes the sign, or zeros."""
    bits, one, last = by & _u(WORD - 1), _u(1), _u(WORD - 1)
    near = by < WORD
    if left:
        high = a[1] << bits
        return _choose(near, ((a[0] << bits) | ((a[1] >> one) >> (last - bits)), high), (high, np.zeros_like(high)))
    fill = np.where(_negative(a), _ONES, _u(0)) if signed else np.zeros_like(a[0])
    low = (a[0] >> bits) | ((fill << one) << (last - bits))
    return _choose(near, (low, (a[1] >> bits) | ((a[0] << one) << (last - bits))), (fill, low))


def _fitted(a: Words, bits: int, signed: bool) -> Words:
    """The low `bits`, extended to all of them."""
    if bits == 2 * WORD:
        return a
    top = 0 if bits > WORD else 1
    kept = _u(2 ** (bits - WORD if bits > WORD else bits) - 1)
    minus = (a[top] & (kept ^ (kept >> _u(1)))) != 0 if signed else np.zeros(len(a[top]), bool)
    word = np.where(minus, a[top] | ~kept, a[top] & kept)
    return (word, a[1]) if bits > WORD else (np.where(minus, _ONES, _u(0)), word)


def _compared(op: str, a: Words, b: Words, signed: bool) -> Words:
    high = (lambda x: x[0].view(np.int64)) if signed else (lambda x: x[0])
    same = (a[0] == b[0]) & (a[1] == b[1])
    less = (high(a) < high(b)) | ((a[0] == b[0]) & (a[1] < b[1]))
    test = {"Eq": same, "Ne": ~same, "Lt": less, "Le": less | same, "Gt": ~(less | same), "Ge": ~less}[op]
    return np.zeros_like(a[0]), test.astype(_u)


def _computed(op: str, bits: int, signed: bool, a: Words, b: Words | None) -> Words:
    if op in COMPARISONS:
        return _compared(op, a, b, signed)
    if op in ("Div", "Rem"):
        out = _quotient(op, a, b, signed)
    elif op in ("Shl", "Shr"):
        out = _moved(a, b[1] % _u(bits), op == "Shl", signed)
    elif op in ("BitXor", "BitAnd", "BitOr"):
        word = {"BitXor": np.bitwise_xor, "BitAnd": np.bitwise_and, "BitOr": np.bitwise_or}[op]
        out = word(a[0], b[0]), word(a[1], b[1])
    else:
        out = {"Add": _add, "Sub": _sub, "Mul": _mul}[op](a, b) if b is not None else {"Not": _not, "Neg": _neg}.get(op, lambda x: x)(a)
    return _fitted(out, bits, signed)


def _on_batches(op: str, bits: int, signed: bool, *values: Column) -> Column:
    def run(*columns: pa.Array) -> pa.Array:
        words = [pc.struct_field(c, part) for c in columns for part in ("hi", "lo")]
        missing = np.logical_or.reduce([w.is_null().to_numpy(zero_copy_only=False) for w in words])
        plain = [pc.fill_null(w, 0).to_numpy(zero_copy_only=False).view(_u) for w in words]
        if op in ("Div", "Rem"):
            missing = missing | ((plain[2] | plain[3]) == 0)
        with np.errstate(over="ignore"):
            out = _computed(op, bits, signed, (plain[0], plain[1]), (plain[2], plain[3]) if len(plain) > 2 else None)
        parts = [pa.array(w.astype(_u, copy=False).view(np.int64)) for w in out]
        return pa.StructArray.from_arrays(parts, ["hi", "lo"], mask=pa.array(missing))

    one = lambda x: run(x)
    two = lambda x, y: run(x, y)
    return F.arrow_udf(one if len(values) == 1 else two, "hi long, lo long")(*values)


def of_long(x: Column) -> Column:
    """A signed long as a value."""
    return F.struct(F.shiftright(x.cast("long"), 63).alias("hi"), x.cast("long").alias("lo"))


def wrap_wide(x: Column, bits: int, signed: bool = True) -> Column:
    """A value converted to a type of 8 to 128 bits: its low bits, extended."""
    return _on_batches("Wrap", bits, signed, x)


def wide_unary(op: str, x: Column, bits: int, signed: bool = True) -> Column:
    """Not (of all bits) or Neg of a value, wrapped to its type; null of null."""
    return _on_batches(op, bits, signed, x)


def wide_arithmetic(op: str, x: Column, y: Column, bits: int, signed: bool = True) -> Column:
    """A BINARY operation on two values of one type of 8 to 128 bits, wrapped to it; null where an operand is null or the divisor 0.

    Quotients go towards 0 and remainders have the dividend's sign; shifts take the low bits of the amount, modulo the width, and shift in the
    sign; comparisons give 0 or 1."""
    return _on_batches(op, bits, signed, x, y)
