"""Column functions on arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.types import DECODE


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, float) else by
    return F.transform(a, lambda x: x * by)


def axpy(a: Column | float, x: Column, y: Column) -> Column:
    """a * x + y"""
    a = F.lit(a) if isinstance(a, float) else a
    return F.zip_with(x, y, lambda p, q: a * p + q)


def zeros(d: int) -> Column:
    return F.array_repeat(F.lit(0.0), d)


def decode(v: Column) -> Column:
    """16-bit fixed point to double."""
    return v.cast("double") * F.lit(DECODE)


def encode(v: Column) -> Column:
    """double to 16-bit fixed point, cut towards zero."""
    return (v * F.lit(32767.0)).cast("smallint")


def parse_doubles(line: Column, separator: str = r"\s+") -> Column:
    line = F.trim(line) if separator == " " else F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.transform(F.split(line, separator), lambda t: t.cast("double"))


def format_doubles(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), " ")


def sammon(weight: Column, d: Column, average: float, factor: float = 0.001) -> Column:
    """weight over the distance, which counts as factor * average at least."""
    return weight / F.greatest(d, F.lit(factor * average))


Transform = Callable[[Column], Column]
