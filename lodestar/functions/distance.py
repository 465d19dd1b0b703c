"""Distances as Columns. With a known dimension they unroll into plain arithmetic, which code generation fuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_squared(a: Column, b: Column, dim: int | None = None, kind: str = "double") -> Column:
    """The sum, from the left, of squared differences."""
    zero = F.lit(0).cast(kind)
    if dim is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), zero, lambda s, x: s + x)
    return reduce(lambda s, i: s + (a[i] - b[i]) * (a[i] - b[i]), range(dim), zero)


def l2(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.sqrt(l2_squared(a, b, dim))


def inner_product(a: Column, b: Column, dim: int | None = None, kind: str = "double") -> Column:
    zero = F.lit(0).cast(kind)
    if dim is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, x: s + x)
    return reduce(lambda s, i: s + a[i] * b[i], range(dim), zero)


def negative_inner_product(a: Column, b: Column, dim: int | None = None, kind: str = "double") -> Column:
    """Smaller is nearer."""
    return -inner_product(a, b, dim, kind)


def l2_early_stop(a: Column, b: Column, cutoff: Column, kind: str = "double") -> Column:
    """The first partial sum of squared differences above cutoff, or the whole sum."""
    step = lambda s, x: F.when(s > cutoff, s).otherwise(s + x)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast(kind), step)


def quantise_u8(v: Column) -> Column:
    """Components of [-1, 1] as integers from 0 to 255."""
    return F.transform(v, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
