"""Column functions over doubles and arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def finite(c: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def or_null(c: Column) -> Column:
    """The value if finite, else null."""
    return F.when(finite(c), c)


def or_zero(c: Column) -> Column:
    """The value if finite, else 0."""
    return F.when(finite(c), c).otherwise(0.0)


def parsed(c: Column) -> Column:
    """Text to a finite double; anything else is null."""
    return or_null(c.try_cast("double"))


def doubles(c: Column) -> Column:
    """Any numeric array as array<double>."""
    return F.transform(c, lambda x: x.cast("double"))


def vector(values: Sequence[float]) -> Column:
    """A literal array<double>."""
    return F.array(*[F.lit(float(v)) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once: a plain reference inside a lambda would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def deviation(a: Column, centre: Column) -> Column:
    """Population standard deviation about a known mean."""
    return let(centre, lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))


def guarded(scale: Column) -> Column:
    """A divisor: 1 in place of one below EPS."""
    return F.when(scale < EPS, 1.0).otherwise(scale)


def cleaned(a: Column) -> Column:
    """Non-finite elements to 0, as after every pretreatment step."""
    return F.transform(a, or_zero)


def half_even(c: Column) -> Column:
    """Rounding to the nearest integer, halves to even."""
    return F.bround(c).cast("int")


def seed_column(*parts: Column) -> Column:
    """`config.stable_seed` of text columns, as bigint."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number within (0, 1) that is a function of the parts: 52 bits of their MD5, joined by '|'."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("bigint")
    return (bits + 0.5) / float(1 << 52)
