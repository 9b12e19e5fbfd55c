"""Exact rationals of longs as SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Euclid's steps that two longs can need.
STEPS = 92


def gcd(a: str, b: str) -> str:
    return (
        f"aggregate(sequence(1, {STEPS}), named_struct('a', cast(abs({a}) as bigint), 'b',"
        f" cast(abs({b}) as bigint)), (s, i) -> if(s.b = 0, s,"
        " named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"
    )


def lcm(a: str, b: str) -> str:
    return f"({a}) div {gcd(a, b)} * ({b})"


def text(num: str, den: str) -> str:
    """``n/d`` reduced, the denominator always shown; zero is 0/1."""
    common = gcd(num, den)
    return f"concat(({num}) div {common}, '/', ({den}) div {common})"


def ceil_div(a: str, b: str) -> str:
    """Least integer at least a / b, for positive b, exact on longs."""
    return f"(({a}) div ({b}) + if(({a}) % ({b}) > 0, 1, 0))"


#: 5 ** 12; a number times 10 ** 12 is this many times it, twelve bits up.
_FIVES = 5**12


def with_text(df: DataFrame, x: str, name: str) -> DataFrame:
    """``df`` with the double ``x`` (finite, below 2 ** 63) as text with twelve
    digits after the point, as C's printf rounds it: by the exact binary value,
    ties to even.  Java's formatter rounds the shortest decimal, ties up.  Null
    stays null.

    The fraction is cut into three limbs of 32 bits, all its bits from 2 ** -43
    up; what is below rounds to zero in any case.  Limbs times 5 ** 12 fit longs.
    """
    own = df.columns
    steps = (
        (f"cast({x} as double) as _x",),
        ("abs(_x) - floor(abs(_x)) as _f", "floor(abs(_x)) as _whole"),
        (f"_f * {1 << 32}D as _f1",),
        (f"(_f1 - floor(_f1)) * {1 << 32}D as _f2",),
        (f"floor((_f2 - floor(_f2)) * {1 << 32}D) * {_FIVES} as _p3",),
        (f"floor(_f2) * {_FIVES} + shiftright(_p3, 32) as _p2",),
        (f"floor(_f1) * {_FIVES} + shiftright(_p2, 32) as _p1", f"((_p2 | _p3) & {(1 << 32) - 1}) <> 0 as _more"),
        ("shiftright(_p1, 20) as _k", f"_p1 & {(1 << 20) - 1} as _r"),
        (f"_k + if(_r > {1 << 19} or _r = {1 << 19} and (_more or _k % 2 = 1), 1, 0) as _digits",),
    )
    for step in steps:
        df = df.selectExpr("*", *step)
    return df.selectExpr(
        *(f"`{c}`" for c in own),
        "concat(if(_x < 0 or _x = 0 and cast(_x as string) = '-0.0', '-', ''),"
        f" _whole + _digits div {10**12}, '.', lpad(_digits % {10**12}, 12, '0')) as {name}",
    )
