"""Vector algebra over array columns, and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distances import dot, l1, l2


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def average(a: Column, b: Column) -> Column:
    """Element means of two whole-number vectors, rounded down."""
    return F.zip_with(a, b, lambda x, y: F.floor((x + y) / 2))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def manhattan_length(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = length(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def fill(value: float, size: int) -> Column:
    return F.array_repeat(F.lit(value), size)


def subset(a: Column, keep: list[bool]) -> Column:
    """The dimensions that are kept."""
    return F.array(*[F.get(a, F.lit(i)) for i, k in enumerate(keep) if k])


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the first component that differs."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def rounded_mean(a: Column) -> Column:
    return F.floor(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a) + 0.5)


def is_binary(a: Column) -> Column:
    return F.forall(a, lambda x: (x == 0) | (x == 1))


def grouped_digits(value: Column) -> Column:
    """Whole numbers with thousands separators."""
    return F.format_number(value, 0)


def printable_error(error: Column, most: Column, size: int) -> Column:
    """Errors of 0/1 data are shown per vector, others per component."""
    return F.when(most == 1, error * size).otherwise(error)


manhattan, distance = l1, l2
