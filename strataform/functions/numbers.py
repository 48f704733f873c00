"""Numeric expressions over scalars and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounding where halves go up, also below zero (round(-2.5) is -2)."""
    return F.floor(x + 0.5)


def mean_or_zero(x: Column) -> Column:
    """The mean; 0 over no rows."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def doubles(v: Column) -> Column:
    """An array widened before any arithmetic, so that products aren't cut to floats."""
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from left to right in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also if the body uses it once per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """A vector at length 1; a zero vector stays zero."""
    length = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
    divided = lambda w: let(length(w), lambda n: F.transform(w, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))
    return let(doubles(v), divided)


def quantized_scale(v: Column) -> Column:
    """The greatest absolute value, 1 for a zero vector."""
    return let(F.array_max(F.transform(doubles(v), F.abs)), lambda top: F.when(top > 0, top).otherwise(1.0))


def quantize(v: Column, scale: Column) -> Column:
    """Codes from -127 to 127 of a vector, for its scale."""
    code = lambda s: F.transform(doubles(v), lambda x: F.least(F.greatest(half_up(x / s * 127), F.lit(-127)), F.lit(127)).cast("tinyint"))
    return let(scale, code)


def dequantize(codes: Column, scale: Column) -> Column:
    """A vector of length 1 from its codes."""
    return unit(let(scale, lambda s: F.transform(codes, lambda c: c.cast("double") / 127 * s)))
