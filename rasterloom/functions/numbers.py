"""Fixed-point and integer helpers as columns. UQ15: 1.0 is 32768."""

from __future__ import annotations

import base64
import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = 32768


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def to_uq15(v: Column) -> Column:
    """0-1 to fixed point, half up, clamped to 0-32768."""
    return clamp(F.floor(v * ONE + 0.5), 0, ONE).cast("int")


def byte_to_uq15(v: Column) -> Column:
    """0-255 to 0-32768, rounded."""
    return F.floor((v * ONE + 127) / 255).cast("int")


def uq15_to_byte(v: Column) -> Column:
    return clamp(F.shiftright(v * 255 + ONE // 2, 15), 0, 255).cast("int")


def uq15_product(a: Column, b: Column) -> Column:
    return F.shiftright(a * b + ONE // 2, 15)


def div_ceiling(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("int")


def power_of_two_floor(v: Column, n: int) -> Column:
    return v.bitwiseAND(F.lit(~(n - 1)))


def power_of_two_ceiling(v: Column, n: int) -> Column:
    return (v + (n - 1)).bitwiseAND(F.lit(~(n - 1)))


def greatest_common_divisor(a: Column, b: Column) -> Column:
    """Euclid's, in a fold: 48 steps do for any two ints. Zero and zero give zero."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % s["y"]).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: s["x"])


def is_odd(v: Column) -> Column:
    return v.bitwiseAND(F.lit(1)) == 1


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def roughly_equal(a: Column, b: Column, within: float = 1e-3) -> Column:
    return F.abs(a - b) < within


def fixed(v: Column) -> Column:
    """A number as UQ15, half to even, not clamped."""
    return F.bround(v * ONE, 0).cast("int")


def unfixed(v: Column, bits: int = 15) -> Column:
    """Fixed point with so many fraction bits to a whole number, half up."""
    return F.shiftright(v + (1 << (bits - 1)), bits)


def mean_up(a: Column, b: Column) -> Column:
    return F.shiftright(a + b + 1, 1)


def mean_down(a: Column, b: Column) -> Column:
    return F.shiftright(a + b, 1)


def rational(value: float, tolerance: float = 1e-8, steps: int = 20) -> tuple[int, int]:
    """A small fraction near the value, by continued fractions."""
    sign, x = (-1 if value < 0 else 1), abs(value)
    n0, d0, n1, d1 = 0, 1, 1, 0
    rest = x
    for _ in range(steps):
        a = math.floor(rest)
        n0, d0, n1, d1 = n1, d1, a * n1 + n0, a * d1 + d0
        if abs(x - n1 / d1) < tolerance or rest == a:
            break
        rest = 1 / (rest - a)
    return sign * n1, d1


def short_hash(text: str) -> str:
    """Eight base32 signs of BLAKE2b with a 40-bit digest, over UTF-16 little-endian.

    >>> short_hash("a")
    'ENU7SIT3'
    """
    return base64.b32encode(hashlib.blake2b(text.encode("utf-16-le"), digest_size=5).digest()).decode()


def short_hashes(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: None if t is None else short_hash(t))

    return run(text)
