"""Vectors as arrays of doubles: all of it higher-order functions, summed in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    """Elements as DOUBLE, so that differences of FLOATs aren't rounded to FLOAT."""
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2_normalized(a: Column) -> Column:
    """a over its length; a vector of zeros as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def half(x: Column) -> Column:
    """x rounded to binary16, half to even: 11 bits from 2**-14 on, multiples of 2**-24 below, infinite from 65520 on. NaN stays NaN."""
    size = F.abs(x)
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    return F.when(size == 0, x).when(F.isnan(x), x).when(size >= 65520, F.signum(x) * F.lit(float("inf"))).otherwise(F.bround(x / unit, 0) * unit)
